"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import session
from tidemark.llm import bpe, bytetree, chat, common, linededup, packing, quality, simhash, substring, suffix, tokens, topk, trie, vectorcodes

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
MULTI_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    session.ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokens.token_counts(_documents(spark, sf_dir), BYTE_BPE, BYTE_RANKS)
    return out.withColumn("over_limit", F.col("n_tokens") > 1024)


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(_documents(spark, sf_dir), WORD_BPE)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.suffix_dedup(_documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(_documents(spark, sf_dir), BYTE_BPE, BYTE_RANKS)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = quality.apply_policy(quality.measure(_documents(spark, sf_dir)), quality.STANDARD)
    return quality.apply_policy(ledger, quality.BASE, "_base").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("_base")).alias("base_failed"), "kept", "failures"
    )


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every policy's rules from one stored ledger: what each rejects, and what it alone rejects."""
    ledger = common.stored(quality.measure(_documents(spark, sf_dir)).select("doc_id", "failures"))
    first, *others = (quality.ablations(ledger, p) for p in (quality.BASE, quality.STANDARD_1, quality.STANDARD, quality.STRICT))
    for other in others:
        first = first.union(other)
    return first


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.substring_dedup(_documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    session.ship(spark)
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql("SELECT -7L AS conv_id, turn, role, :said AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)", {"said": said})
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").union(extra)
    trees, leaf_of = chat.formatted(rows)
    digests = chat.contents(trees).select(
        "digest",
        "n_turns",
        F.sha2(F.col("turns_text").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
    leaf_of = common.checkpointed(leaf_of.withColumnRenamed("conv", "conv_id"))
    counted = digests.join(leaf_of.groupBy("digest").agg(F.count("*").alias("n")), "digest")
    return common.join_counted(leaf_of, common.checkpointed(counted), "digest", "conv_id", leaf_of.count()).drop("digest", "n")


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    session.ship(spark)
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(rows, F.col("vec_id") % 50 == 0)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.line_dedup(_documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    session.ship(spark)
    out = vectorcodes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    books = ",".join(str(x) for part in out.codebooks for entry in part for x in entry)
    return vectorcodes.with_label_error(out.codes).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(hashlib.sha256(books.encode()).hexdigest()).alias("codebooks_sha256")
    )


def op12_byte_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bytetree.encode_decode(_documents(spark, sf_dir), MULTI_RANKS, public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    session.ship(spark)
    conv = F.col("conv")
    taken = (F.crc32(conv.cast("string").cast("binary")) % 4).cast("int")
    rows = trie.turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return trie.prefix_trie(trie.spliced(rows, conv - conv % 20, taken, 3))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_bpe_round_trip,
        op3_substring_dedup,
        op4_chat_format,
        op5_suffix_dedup,
        op6_packing,
        op7_exact_top_k,
        op8_quality_rules,
        quality_ablations,
        op9_line_dedup,
        op10_simhash_near_dedup,
        op11_vector_codes,
        op12_byte_bpe_round_trip,
        op13_prefix_trie,
    )
}

_SPACE = r"[\x20\x09-\x0D]"
_DOCS = "d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"
_WORDS = f"w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '{_SPACE}+'), lambda x: x <> '') AS w FROM d)"
_CONTROL = r"<\\*/s>|<\\*s>|\[\\*INST:|\[\\*INST\]|\[\\*/INST\]|<\\*\||<\\*<SYS>>|<\\*</SYS>>"

#: Every rule of the ledger as SQL has it, in the order of its bits.
_FAILS = (
    "n_words < 50", "100 * n_repeat_words > 50 * n_words", "10 * n_symbols > 2 * n_words", "100 * n_dup_lines > 50 * n_lines", "word_chars < 2 * n_words OR word_chars > 20 * n_words",
    "n_words > 100000", "len(list_filter(w, lambda x: length(x) > 1000)) > 0", "100 * len(list_filter(w, lambda x: regexp_matches(x, '\\p{L}'))) < 80 * n_words",
    "100 * len(list_filter(w, lambda x: x = upper(x) AND x <> lower(x))) > 40 * n_words", "100 * len(list_distinct(w)) < 10 * n_words",
    "len(list_intersect(w, ['the', 'be', 'to', 'of', 'and', 'that', 'have', 'with'])) < 2",
    f"100 * len(list_filter(l, lambda x: regexp_matches(x, '^{_SPACE}*[-*\u2022\u00b7]'))) > 90 * n_lines", f"100 * len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|\u2026){_SPACE}*$'))) > 30 * n_lines",
    f"100 * len(list_filter(l, lambda x: regexp_matches(x, '[.!?\u3002\"'')\u00bb\u201d]{_SPACE}*$'))) < 12 * n_lines", "10 * (length(t) - length(translate(t, '{}', ''))) > n_words",
    "100 * (length(t) - length(replace(t, '\ufffd', ''))) > word_chars", "contains(lower(t), 'lorem ipsum')",
)
_LEDGER = f"""{_DOCS}, {_WORDS},
 m AS (SELECT doc_id, t, w, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{_SPACE}', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM w),
 g AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
 k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g),
 r AS (SELECT doc_id, sum(x)::BIGINT AS n FROM (SELECT doc_id, least(3, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 3)) AS x FROM k WHERE n > 1) GROUP BY 1),
 n AS (SELECT m.*, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM m LEFT JOIN r ON r.doc_id = m.doc_id),
 f AS (SELECT *, ({" + ".join(f"CASE WHEN {x} THEN {1 << k} ELSE 0 END" for k, x in enumerate(_FAILS))})::BIGINT AS failures FROM n)"""
_POLICIES = ", ".join(f"('{p.name}', {p.version}, {p.mask})" for p in (quality.BASE, quality.STANDARD_1, quality.STANDARD, quality.STRICT))
_RULES = ", ".join(f"('{r.name}', {1 << k})" for k, r in enumerate(quality.RULES))

_APART = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"


def _lloyd(rounds: int) -> str:
    """Assignments a0, a1, ... of all parts (p) to codebooks c0, c1, ..., ties to the lower entry."""
    out = []
    for k in range(rounds + 1):
        out.append(f"a{k} AS MATERIALIZED (SELECT vec_id, part, any_value(x) AS x, min({{'d': {_APART}, 'k': k}}) AS m FROM p JOIN c{k} USING (part) GROUP BY vec_id, part)")
        if k < rounds:
            mean = "((sum(x[j]) - (sum(x[j]) % count(*) + count(*)) % count(*)) // count(*))::BIGINT"
            moved = f"SELECT part, k, list(q ORDER BY j) AS c FROM (SELECT part, m.k AS k, j, {mean} AS q FROM a{k}, range(1, 9) t(j) GROUP BY part, m.k, j) GROUP BY part, k"
            out.append(f"c{k + 1} AS MATERIALIZED (SELECT part, k, coalesce(n.c, o.c) AS c FROM c{k} o LEFT JOIN ({moved}) n USING (part, k))")
    return ", ".join(out)


#: CRC-32 of a number's decimal digits, bit by bit.
_BITS = "flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: list_transform(range(8), lambda i: (ascii(x)::BIGINT >> i) & 1)))"
_CRC32 = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {_BITS}), lambda a, b: xor(a >> 1, CASE WHEN xor(a, b) & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)), 4294967295::BIGINT)"

#: In DuckDB's SQL. Tokenizers, XXH64 and windows over bytes are beyond SQL (or too slow in it).
ORACLE_SQL: dict[str, str] = {
    "op3_substring_dedup": f"""WITH {_DOCS}, {_WORDS},
 p AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS j, unnest(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i + 19 <= len(w) THEN array_to_string(w[i : i + 19], ' ') END)) AS k FROM w),
 s AS (SELECT *, CASE WHEN k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY doc_id, j) > 1 THEN 1 ELSE 0 END AS late FROM p),
 c AS (SELECT *, max(late) OVER (PARTITION BY doc_id ORDER BY j ROWS 19 PRECEDING) AS gone FROM s)
 SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w
 LEFT JOIN (SELECT doc_id, sum(gone) AS n, string_agg(word, ' ' ORDER BY j) FILTER (gone = 0) AS kept FROM c GROUP BY 1) x ON x.doc_id = w.doc_id""",
    "op4_chat_format": rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
 UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]')
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256,
 coalesce(sum(length(t)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
 sum(12 + length(r) + len(regexp_extract_all(r, '{_CONTROL}')) + 2 * len(regexp_extract_all(r, '[%\]]')) + length(t) + len(regexp_extract_all(t, '{_CONTROL}')))::BIGINT AS formatted_chars FROM c GROUP BY 1""",
    "op7_exact_top_k": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 50 = 0),
 r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s) SELECT * FROM r WHERE rank <= 5""",
    "op11_vector_codes": f"""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 p AS MATERIALIZED (SELECT vec_id, part, v[8 * part + 1 : 8 * part + 8] AS x FROM e, range(8) t(part)),
 c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS k, x AS c FROM p WHERE vec_id IN (SELECT vec_id FROM e ORDER BY vec_id LIMIT 16)), {_lloyd(6)},
 b AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, k)) AS h FROM c6),
 r AS (SELECT vec_id, string_agg(printf('%02x', m.k), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM a6 GROUP BY 1)
 SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM r JOIN e USING (vec_id), b""",
    "op13_prefix_trie": f"""WITH t AS (SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS x
 FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1), h AS (SELECT c, x, {_CRC32} % 4 AS h FROM t),
 b AS MATERIALIZED (SELECT h.c, list_concat(coalesce(o.x[1 : h.h], []), h.x[h.h + 1 :]) AS x FROM h LEFT JOIN t o ON o.c = h.c - h.c % 20),
 m AS MATERIALIZED (SELECT c, d, x, x[1 : d] AS node FROM (SELECT c, x, unnest(range(len(x) + 1)) AS d FROM b)),
 n AS MATERIALIZED (SELECT d, node, CASE WHEN d > 0 THEN node[1 : d - 1] END AS up, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(x) = d), '')) AS ends_sha256,
 CASE WHEN d > 0 THEN (count(*) - 1) * len(regexp_extract_all(node[d].t, '[^\x20\x09-\x0D]+')) ELSE 0 END AS saved FROM m GROUP BY d, node),
 k AS MATERIALIZED (SELECT d - 1 AS d, up AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
 s AS (SELECT e AS d, node[1 : e] AS node, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (leaf) AS n_leaves
 FROM (SELECT n.node, n.saved, k.node IS NULL AS leaf, unnest(range(n.d + 1)) AS e FROM n LEFT JOIN k ON k.d = n.d AND k.node = n.node) GROUP BY 1, 2)
 SELECT n.conv_id, n.d AS depth, o.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
 FROM n JOIN s ON s.d = n.d AND s.node = n.node LEFT JOIN k ON k.d = n.d AND k.node = n.node LEFT JOIN n o ON o.d = n.d - 1 AND o.node = n.up""",
    "op8_quality_rules": f"""WITH {_LEDGER}
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & {quality.BASE.mask}) <> 0 AS base_failed, (failures & {quality.STANDARD.mask}) = 0 AS kept, failures FROM f""",
    "quality_ablations": f"""WITH {_LEDGER}, policies(policy, version, mask) AS (VALUES {_POLICIES}), rules(rule, bit) AS (VALUES {_RULES})
 SELECT policy, version, rule, count(*) FILTER (failures & bit <> 0) AS failed, count(*) FILTER (failures & mask = bit) AS only_this FROM policies JOIN rules ON mask & bit <> 0 LEFT JOIN f ON true GROUP BY ALL""",
    "op9_line_dedup": f"""WITH {_DOCS}, l AS (SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS j FROM (SELECT doc_id, string_split(t, chr(10)) AS x FROM d)),
 k AS (SELECT *, translate(regexp_replace(line, '^{_SPACE}+|{_SPACE}+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
 h AS (SELECT key, max(doc_id) AS stays FROM k WHERE length(key) >= 20 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3),
 z AS (SELECT k.doc_id, line, j, h.key IS NOT NULL AND k.doc_id <> h.stays AS gone FROM k LEFT JOIN h ON h.key = k.key)
 SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY j) FILTER (NOT gone), '')) AS kept_sha256 FROM z GROUP BY 1""",
}
