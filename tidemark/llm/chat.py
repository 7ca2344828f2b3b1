"""Operator 4, chat formatting into prefix trees.

Conversations that begin with the same turns share them: each tree holds conversations with one
first turn, a node is one formatted turn, and the nodes are emitted once, depth first. A token is
a code point of the formatted text. Each node carries its place in the tree's token sequence, the
position ids of its tokens (a begin; they count on from the parent's), and the intervals of its
ancestors' tokens, which together with its own are all it may attend to. Neighbouring intervals
are joined, so a chain of turns has one.

Equal conversations fold into one leaf before trees are built. No task builds a tree of unbounded
size: where more than ``most`` different conversations begin alike (TREE_CONVERSATIONS, or the square root of
all of them), the turns that they share become a trunk, a tree of its own, and what follows a trunk's node is dealt by the next turn over branches
of about ``most`` conversations. A branch names its parent in the trunk and the trunk's tokens
that it may attend to. So each shared turn is emitted once, however many conversations share it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

#: Different conversations for each tree, at least.
TREE_CONVERSATIONS = 256


@dataclass(frozen=True)
class Template:
    """Marks around a turn, and the control strings that texts must not hold.

    A control string inside a text gets a backslash after its first character; where there are
    backslashes already, one more. Taking one away restores the text, whatever it was.
    """

    begin: str = "[INST:"
    middle: str = "]"
    end: str = "</s>\n"
    controls: tuple[str, ...] = ("</s>", "<s>", "[INST:", "[INST]", "[/INST]", "<|", "<<SYS>>", "<</SYS>>")

    def _found(self, slashes: str) -> re.Pattern[str]:
        each = sorted(self.controls, key=len, reverse=True)
        return re.compile("|".join(f"{re.escape(c[0])}{slashes}(?={re.escape(c[1:])})" for c in each))

    def escape(self, text: str) -> str:
        return _compiled(self, r"\\*").sub(lambda m: m[0] + "\\", text)

    def unescape(self, text: str) -> str:
        return _compiled(self, r"\\+").sub(lambda m: m[0][:-1], text)

    def format(self, role: str, text: str) -> tuple[str, int, int]:
        """A formatted turn, and where its escaped text begins and ends."""
        head = self.begin + self.escape(role).replace("%", "%25").replace(self.middle, "%5D") + self.middle
        body = self.escape(text)
        return head + body + self.end, len(head), len(head) + len(body)

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """The (role, text) turns of a formatted conversation."""
        out = []
        for turn in _turns(self, formatted):
            role, _, body = turn.partition(self.middle)
            out.append((self.unescape(role.replace("%5D", self.middle).replace("%25", "%")), self.unescape(body)))
        return out


_cache: dict[tuple[Template, str], re.Pattern[str]] = {}


def _compiled(template: Template, slashes: str) -> re.Pattern[str]:
    key = (template, slashes)
    if key not in _cache:
        _cache[key] = template._found(slashes)  # noqa: SLF001
    return _cache[key]


def _turns(template: Template, formatted: str) -> Iterator[str]:
    at = 0
    while at < len(formatted):
        to = formatted.index(template.end, at)
        yield formatted[at + len(template.begin) : to]
        at = to + len(template.end)


_NODE = "struct<begin: int, end: int, parent: int, position: int, loss_begin: int, loss_end: int, attends: array<struct<begin: int, end: int>>>"
_LEAF = "struct<conversation: string, node: int>"
TREE_SCHEMA = f"tree_id string, parent string, tokens string, nodes array<{_NODE}>, leaves array<{_LEAF}>"


def build_tree(template: Template, conversations: list[tuple[str, list[tuple[str, str]]]], learn: str, base: int = 0) -> tuple[str, list[dict], list[dict]]:
    """Tokens, nodes and leaves of the tree of (digest, turns) conversations, depth first; positions count from ``base``."""
    children: list[dict[tuple[str, str], int]] = [{}]
    turn_of: list[tuple[str, str]] = [("", "")]
    ends: list[list[str]] = [[]]
    for digest, turns in sorted(conversations):
        at = 0
        for turn in turns:
            if turn not in children[at]:
                children[at][turn] = len(children)
                children.append({})
                turn_of.append(turn)
                ends.append([])
            at = children[at][turn]
        ends[at].append(digest)
    tokens, nodes, leaves, length = [], [], [], 0
    leaves += [{"conversation": d, "node": -1} for d in ends[0]]
    stack = [(c, -1) for c in reversed(children[0].values())]
    while stack:
        at, parent = stack.pop()
        text, a, b = template.format(*turn_of[at])
        attends: list[dict] = []
        position = base
        if parent >= 0:
            up = nodes[parent]
            position = up["position"] + up["end"] - up["begin"]
            attends = [dict(x) for x in up["attends"]]
            if attends and attends[-1]["end"] == up["begin"]:
                attends[-1]["end"] = up["end"]
            else:
                attends.append({"begin": up["begin"], "end": up["end"]})
        masked = turn_of[at][0] == learn
        me = len(nodes)
        nodes.append(
            {
                "begin": length, "end": length + len(text), "parent": parent, "position": position,
                "loss_begin": length + a if masked else length, "loss_end": length + b if masked else length, "attends": attends,
            }
        )
        tokens.append(text)
        length += len(text)
        leaves += [{"conversation": d, "node": me} for d in ends[at]]
        stack += [(c, me) for c in reversed(children[at].values())]
    return "".join(tokens), nodes, leaves


def read_back(template: Template, tokens: str, nodes: list[dict], leaf: int, learn: str) -> tuple[list[tuple[str, str]], list[str], int]:
    """A leaf's turns, its texts under the loss mask, and its length, from the emitted tree alone."""
    path = []
    at = leaf
    while at >= 0:
        path.append(nodes[at])
        at = nodes[at]["parent"]
    path.reverse()
    own = [*nodes[leaf]["attends"], {"begin": nodes[leaf]["begin"], "end": nodes[leaf]["end"]}] if path else []
    formatted = "".join(tokens[x["begin"] : x["end"]] for x in own)
    turns = template.parse(formatted)
    learnt = [template.unescape(tokens[x["loss_begin"] : x["loss_end"]]) for x, (role, _) in zip(path, turns, strict=True) if role == learn]
    return turns, learnt, len(formatted)


def collected(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turns, path, digest): each conversation's turns in order; a conversation is one training example.

    ``path`` names each beginning of the conversation, ``digest`` the whole. A null id is a conversation of its
    own, null roles and texts count as empty, a null turn comes first; repeated rows are turns of
    their own. An empty table has no conversations.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    turn = F.struct(F.col(f"`{turn_col}`").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    turns = df.select(F.col(f"`{conv_col}`").cast("long").alias("conv"), turn.alias("x")).groupBy("conv").agg(F.sort_array(F.collect_list("x")).alias("turns"))
    turns = turns.withColumn("turns", F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))))
    sized = F.transform("turns", lambda x: F.sha2(F.concat_ws(" ", F.length(x["role"]), F.length(x["text"]), x["role"], x["text"]).cast("binary"), 256))
    none = F.array().cast("array<string>")
    step = lambda done, x: F.concat(done, F.array(F.sha2(F.concat(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")), x).cast("binary"), 256)))
    return turns.withColumn("path", F.aggregate(sized, none, step)).withColumn("digest", F.element_at("path", -1))


def trees(conversations: DataFrame, template: Template = Template(), learn: str = "assistant", least: int = TREE_CONVERSATIONS) -> DataFrame:  # noqa: B008
    """One row per tree of ``collected`` conversations: tree_id, parent, tokens, nodes, leaves, parent_tree, parent_attends.

    ``parent`` is the beginning (of a ``path``) that a branch goes on from, null for other trees;
    ``parent_tree`` and ``parent_attends`` are its trunk and the tokens there that the branch may
    attend to. Leaves are named by ``digest``; a trunk has one at each node. An empty table gives no trees.
    """
    distinct = common.checkpointed(conversations.groupBy("digest").agg(F.first("turns").alias("turns"), F.first("path").alias("path")))
    most = max(least, math.isqrt(distinct.count()))
    first = F.get("path", F.lit(0))
    roots = distinct.groupBy(first.alias("root")).agg(F.count("*").alias("n")).filter(F.col("n") > most).select("root")
    # fewer than n / most <= sqrt(n) roots, and so many beginnings of each length: small enough to broadcast
    crowded = distinct.join(F.broadcast(roots), first == F.col("root"), "left_semi").select("digest", F.posexplode("path").alias("pos", "prefix"))
    hot = common.checkpointed(crowded.groupBy("prefix").agg(F.count("*").alias("n")).filter(F.col("n") > most))
    deepest = crowded.join(F.broadcast(hot), "prefix").groupBy("digest").agg(F.max(F.struct("pos", "prefix", "n")).alias("trunk"))
    dealt = distinct.join(deepest, "digest", "left").withColumn("cut", F.coalesce(F.col("trunk.pos") + 1, F.lit(0)))
    parts = F.ceil(F.col("trunk.n") / most)
    branches = dealt.filter(F.size("path") > F.col("cut")).select(
        F.coalesce("trunk.prefix", first).alias("root"),
        F.coalesce(F.pmod(F.xxhash64(F.get("path", F.col("cut"))), parts), F.lit(0)).cast("int").alias("salt"),
        F.col("trunk.prefix").alias("parent"), "cut", "digest", "turns",
    )
    shared = dealt.filter("cut > 0").select(first.alias("root"), F.posexplode(F.slice("path", 1, F.col("cut"))).alias("pos", "digest"), "turns")
    shared = shared.withColumn("turns", F.slice("turns", F.lit(1), F.col("pos") + 1)).groupBy("digest").agg(F.first("root").alias("root"), F.first("turns").alias("turns"))
    trunks = shared.select("root", F.lit(-1).alias("salt"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("cut"), "digest", "turns")

    def grow(table: pa.Table) -> pa.Table:
        cut = table.column("cut")[0].as_py()
        rows = [(d, [(x["role"], x["text"]) for x in t]) for d, t in zip(table.column("digest").to_pylist(), table.column("turns").to_pylist(), strict=True)]
        base = sum(len(template.format(*turn)[0]) for turn in rows[0][1][:cut])
        tokens, nodes, leaves = build_tree(template, [(d, t[cut:]) for d, t in rows], learn, base)
        name, parent = f"{table.column('root')[0].as_py()}{table.column('salt')[0].as_py():+d}", table.column("parent")[0].as_py()
        return pa.Table.from_pylist([{"tree_id": name, "parent": parent, "tokens": tokens, "nodes": nodes, "leaves": leaves}], _TREE)

    grown = common.checkpointed(branches.unionByName(trunks).groupBy("root", "salt").applyInArrow(grow, TREE_SCHEMA))
    node = F.get("nodes", F.col("leaf.node"))
    own = F.struct(node["begin"].alias("begin"), node["end"].alias("end"))
    trunk_nodes = grown.filter(F.col("tree_id").endswith("-1")).select("tree_id", "nodes", F.explode("leaves").alias("leaf"))
    trunk_nodes = trunk_nodes.select(F.col("leaf.conversation").alias("parent"), F.col("tree_id").alias("parent_tree"), F.concat(node["attends"], F.array(own)).alias("parent_attends"))
    # only branches have a parent: trees without one stay where they are
    branched = grown.filter("parent IS NOT NULL").join(trunk_nodes, "parent", "left")
    none = [F.lit(None).cast(trunk_nodes.schema[c].dataType).alias(c) for c in ("parent_tree", "parent_attends")]
    return branched.unionByName(grown.filter("parent IS NULL").select("*", *none))


_SPAN = pa.struct([("begin", pa.int32()), ("end", pa.int32())])
_TREE = pa.schema(
    [
        ("tree_id", pa.string()),
        ("parent", pa.string()),
        ("tokens", pa.string()),
        ("nodes", pa.list_(pa.struct([(c, pa.int32()) for c in ("begin", "end", "parent", "position", "loss_begin", "loss_end")] + [("attends", pa.list_(_SPAN))]))),
        ("leaves", pa.list_(pa.struct([("conversation", pa.string()), ("node", pa.int32())]))),
    ]
)


def contents(trees_: DataFrame, template: Template = Template(), learn: str = "assistant") -> DataFrame:  # noqa: B008
    """(digest, n_turns, turns_text, loss_text, formatted_chars) of every leaf, read back from the trees, a trunk's leaves included.

    No trees give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                parent, tokens, nodes, leaves = (batch.column(c)[k].as_py() for c in ("parent", "tokens", "nodes", "leaves"))
                rows = []
                for leaf in leaves:
                    turns, learnt, length = read_back(template, tokens, nodes, leaf["node"], learn)
                    said = "".join(f"{role}\n{text}\n" for role, text in turns)
                    rows.append({"digest": leaf["conversation"], "parent": parent, "n_turns": len(turns), "turns_text": said, "loss_text": "".join(learnt), "formatted_chars": length})
                yield pa.RecordBatch.from_pylist(rows, _CONTENT)

    read = lambda some: trees_.filter(some).select("parent", "tokens", "nodes", "leaves").mapInArrow(run, "digest string, parent string, n_turns long, turns_text string, loss_text string, formatted_chars long")
    trunk = read(F.col("tree_id").endswith("-1"))
    before = trunk.select(F.col("digest").alias("parent"), *[F.col(c).alias(f"_{c}") for c in _READ])
    leaves = trees_.filter("parent IS NOT NULL").groupBy("parent").agg(F.sum(F.size("leaves")).alias("n"))  # one beginning may have any share of them
    counted = common.checkpointed(before.join(leaves, "parent"))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    joined = common.join_counted(read(F.col("parent").isNotNull()), counted, "parent", "digest", total)
    whole = [F.coalesce(f"_{c}", F.lit(0)) + F.col(c) if c in ("n_turns", "formatted_chars") else F.concat(F.coalesce(f"_{c}", F.lit("")), c) for c in _READ]
    branches = joined.select("digest", *[x.alias(c) for x, c in zip(whole, _READ, strict=True)])
    return branches.union(read(F.col("parent").isNull()).select("digest", *_READ))  # whole by themselves, nothing to join


_READ = ("n_turns", "turns_text", "loss_text", "formatted_chars")
_CONTENT = pa.schema(
    [("digest", pa.string()), ("parent", pa.string()), ("n_turns", pa.int64()), ("turns_text", pa.string()), ("loss_text", pa.string()), ("formatted_chars", pa.int64())]
)


def formatted(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    template: Template = Template(),  # noqa: B008
    learn: str = "assistant",
    least: int = TREE_CONVERSATIONS,
) -> tuple[DataFrame, DataFrame]:
    """The trees, and (conv, digest) saying which leaf is each conversation's.

    Turns are ordered by turn, role, text, with a null turn first; null roles and texts count as
    empty; repeated rows are turns of their own. A null conversation id is one conversation of its
    own. Extra columns are ignored; an empty table gives no trees.
    """
    all_ = collected(df, conv_col, turn_col, role_col, text_col)
    return trees(all_, template, learn, least), all_.select("conv", "digest")
