"""Operator 8, quality rules as a bitmask ledger, in DataFrame functions only.

``measure`` evaluates every rule once: a row holds the measurements and one failure bit per rule.
``store`` keeps the ledger as a table; a policy is a named, versioned mask of the rules it
enforces, so ``apply_policy`` and ``ablations`` work on the bits alone, whatever the policy,
and never look at a text again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A failure condition over the measurements; its place in RULES is its bit."""

    name: str
    fails: str


#: The bits are positions in this tuple: rules are only ever appended.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > 2 * n_words"),
    Rule("duplicate_lines", "100 * n_dup_lines > 50 * n_text_lines"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule("many_words", "n_words > 100000"),
    Rule("long_word", "longest_word > 1000"),
    Rule("letters", "100 * n_letter_words < 80 * n_words"),
    Rule("capitals", "100 * n_capital_words > 40 * n_words"),
    Rule("vocabulary", "100 * n_unique_words < 10 * n_words"),
    Rule("stop_words", "n_stop_words < 2"),
    Rule("bullet_lines", "100 * n_bullet_lines > 90 * n_text_lines"),
    Rule("ellipsis_lines", "100 * n_ellipsis_lines > 30 * n_text_lines"),
    Rule("open_lines", "100 * n_ended_lines < 12 * n_text_lines"),
    Rule("braces", "10 * n_braces > n_words"),
    Rule("replaced", "100 * n_replaced > word_chars"),
    Rule("placeholder", "placeholder"),
)

#: English stop words, and what lines begin or end with.
STOP_WORDS = ("the", "be", "to", "of", "and", "that", "have", "with")
_BULLET, _ELLIPSIS, _ENDED = "^[ \\t-\\r]*[-*\u2022\u00b7]", "(\\.\\.\\.|\u2026)[ \\t-\\r]*$", "[.!?\u3002\"')\u00bb\u201d][ \\t-\\r]*$"
_PLACEHOLDER = "lorem ipsum"


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << k for k, r in enumerate(RULES) if r.name in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
STANDARD_1 = Policy("standard", 1, ("few_words", "repeated_words", "symbols", "duplicate_lines", "word_length"))
#: Rules that hold in any language; version 2 adds those on words and lines.
STANDARD = Policy("standard", 2, (*STANDARD_1.rules, "long_word", "letters", "capitals", "vocabulary", "bullet_lines", "ellipsis_lines", "braces", "replaced", "placeholder"))
#: For English text.
STRICT = Policy("strict", 1, tuple(r.name for r in RULES))


_MORE = (
    "longest_word", "n_letter_words", "n_capital_words", "n_unique_words", "n_stop_words", "n_bullet_lines", "n_ellipsis_lines", "n_ended_lines", "n_braces", "n_replaced", "placeholder",
)


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, carried columns, measurements, ``failures``) for every row, from its whole text.

    A null text has no words. A word is a run of characters other than ASCII white space;
    ``n_repeat_words`` counts words in three-word windows that occur twice or more in the text.
    Repeated rows, null ids and extra columns pass unharmed; nothing is shuffled.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    carried = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_carried")] if carry else []
    kept = ["_carried"] if carry else []
    split = df.select(
        F.col(f"`{id_col}`").alias("_id"),
        *carried,
        F.array_remove(F.split(text, "[ \\t-\\r]+"), "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda x: F.length(_without(x, _SPACE)) > 0).alias("_lines"),
        F.length(_without(text, _SPACE)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_without(text, _SYMBOLS))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.replace(F.replace(text, F.lit("{"), F.lit("")), F.lit("}"), F.lit("")))).cast("long").alias("n_braces"),
        (F.length(text) - F.length(F.replace(text, F.lit("\ufffd"), F.lit("")))).cast("long").alias("n_replaced"),
        F.contains(F.lower(text), F.lit(_PLACEHOLDER)).alias("placeholder"),
    )
    words = F.col("_words")
    count = lambda array, test: F.size(F.filter(array, test)).cast("long")
    window = lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))
    windows = F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(0), F.size(words) - 3), window))
    sorted_ = split.select(
        "_id",
        *kept,
        F.size(words).cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("_lines").cast("long").alias("n_text_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(windows).alias("_sorted"),
        F.coalesce(F.array_max(F.transform(words, F.length)), F.lit(0)).cast("long").alias("longest_word"),
        count(words, lambda x: x.rlike("\\p{L}")).alias("n_letter_words"),
        count(words, lambda x: (x == F.upper(x)) & (x != F.lower(x))).alias("n_capital_words"),
        F.size(F.array_distinct(words)).cast("long").alias("n_unique_words"),
        F.size(F.array_intersect(words, F.array(*map(F.lit, STOP_WORDS)))).cast("long").alias("n_stop_words"),
        count("_lines", lambda x: x.rlike(_BULLET)).alias("n_bullet_lines"),
        count("_lines", lambda x: x.rlike(_ELLIPSIS)).alias("n_ellipsis_lines"),
        count("_lines", lambda x: x.rlike(_ENDED)).alias("n_ended_lines"),
        "n_braces",
        "n_replaced",
        "placeholder",
    )
    same = lambda x, k: x["h"] == F.get(F.col("_sorted"), k)["h"]
    found = sorted_.withColumn(
        "_sorted",
        F.sort_array(F.transform(F.filter("_sorted", lambda x, k: F.coalesce(same(x, k - 1), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False))), lambda x: x["i"])),
    )
    step = lambda i, k: F.least(F.lit(3), F.coalesce(F.get(F.col("_sorted"), k + 1) - i, F.lit(3))).cast("long")
    repeated = F.coalesce(F.aggregate(F.transform("_sorted", step), F.lit(0).cast("long"), lambda a, b: a + b), F.lit(0).cast("long"))
    # A filter on the ledger must not be rewritten into filters on these expressions, which would run
    # them anew for every element; Catalyst moves no filter below a non-deterministic projection.
    repeated = F.when(F.monotonically_increasing_id() >= 0, repeated)
    measured = found.select(
        F.col("_id").alias(id_col), *kept, "n_words", "word_chars", "n_symbols", "n_text_lines", "n_dup_lines", repeated.alias("n_repeat_words"), *_MORE
    )
    bits = [F.when(F.expr(r.fails), F.lit(1 << k)).otherwise(F.lit(0)) for k, r in enumerate(RULES)]
    failures = bits[0]
    for b in bits[1:]:
        failures = failures.bitwiseOR(b)
    out = measured.withColumn("failures", failures.cast("long"))
    return out.select("*", *[F.col(f"_carried.`{c}`").alias(c) for c in carry if c != id_col]).drop("_carried") if carry else out


def store(ledger: DataFrame, path: str) -> DataFrame:
    """Write the ledger as a table at ``path`` (which must not exist) and read it: later policies need no text."""
    ledger.write.parquet(path)
    return ledger.sparkSession.read.parquet(path)


def apply_policy(ledger: DataFrame, policy: Policy, name: str = "kept") -> DataFrame:
    """The ledger with a boolean column: no rule of the policy failed."""
    return ledger.withColumn(name, F.col("failures").bitwiseAND(F.lit(policy.mask)) == 0)


def ablations(ledger: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: rows that fail it, and rows that only this rule rejects; zeros for an empty ledger."""
    under = F.col("failures").bitwiseAND(F.lit(policy.mask))
    rules = [(k, r.name) for k, r in enumerate(RULES) if policy.mask >> k & 1]
    sums = ledger.agg(
        *[F.count_if(under.bitwiseAND(F.lit(1 << k)) != 0).alias(f"f{k}") for k, _ in rules],
        *[F.count_if(under == F.lit(1 << k)).alias(f"o{k}") for k, _ in rules],
    )
    each = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"f{k}").alias("failed"), F.col(f"o{k}").alias("only_this")) for k, n in rules])
    return sums.select(F.explode(each).alias("x")).select(F.lit(policy.name).alias("policy"), F.lit(policy.version).alias("version"), "x.*")
