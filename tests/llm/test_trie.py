"""The prefix trie of conversations against a plain one."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pyarrow.parquet as pq

from tidemark.llm import queries as q
from tidemark.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, conv string, key int, depth string, n int, turns string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def grouped(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            by[conv].append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    return {c: [(t[2], t[4]) for t in sorted(turns)] for c, turns in by.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def plain(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall("[^\x20\x09-\x0d]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[c] for c in children[node]) if children[node] else 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[c] for c in children[node])
    return {
        (
            min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), leaves[node], saved[node],
            hashlib.sha256(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(node)).encode()).hexdigest(),
        )
        for node, m in members.items()
    }


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "d", 2, "t") for r in rows], SCHEMA).repartition(3)


def nodes(df):
    got = df.collect()
    assert tuple(df.columns) == COLUMNS and len(got) == len(set(got))
    return {tuple(r) for r in got}


def random_rows(seed, n, deepest, choices, empty=0.1):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(-50, 5 * n), n):
        for t in range(0 if rnd.random() < empty else rnd.randint(1, deepest)):
            rows.append((c, t if rnd.random() > 0.02 else None, rnd.choice(["user", "assistant", None]) if choices > 3 else "user", rnd.choice([f"said {rnd.randrange(choices)} ", None, " \n", "a b  c\x1fd"])))
    return rows


def test_stacks_stitch_across_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "7", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            for seed, (n, deepest, choices) in enumerate([(120, 6, 2), (60, 3, 5), (40, 12, 1)]):
                rows = random_rows(seed, n, deepest, choices)
                rows += [(1000 + k, t, "user", "the same") for k in range(60) for t in range(3)]  # a hot group of copies
                rows += [(2000 + k, t, "user", "the same") for k in range(20) for t in range(5 + k % 2)]
                convs = grouped(rows)
                assert nodes(trie.prefix_trie(trie.turns(table(spark, rows)))) == plain(convs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_spliced(spark):
    from pyspark.sql import functions as F

    rows = random_rows(9, 150, 7, 4)
    taken = (F.crc32(F.col("conv").cast("string").cast("binary")) % 4).cast("int")
    out = trie.spliced(trie.turns(table(spark, rows)), F.col("conv") - F.col("conv") % 20, taken, 3)
    assert nodes(trie.prefix_trie(out)) == plain(rebuilt(grouped(rows)))


def test_edges(spark):
    deep = [(5, t, "user", f"turn {t}") for t in range(700)] + [(6, t, "user", f"turn {t}") for t in range(650)] + [(7, t, "user", f"turn {t}" if t < 300 else "other") for t in range(900)]
    for rows in (
        [(1, None, None, None), (1, 1, "user", "x"), (2, None, "", ""), (None, 0, "user", "no id"), (None, None, None, None), (3, 0, "a", "b"), (3, 0, "a", "b"), (3, 0, "a", "a")],
        [(1, 0, "us", "er x"), (2, 0, "user", " x"), (3, 0, "1:us", "er x")],  # role and text do not run together
        [(4, 0, "user", "word " * 100_000), (9, 0, "user", "word " * 100_000), (9, 1, "user", "")],
        deep,
    ):
        assert nodes(trie.prefix_trie(trie.turns(table(spark, rows)))) == plain(grouped(rows))
    assert nodes(trie.prefix_trie(trie.turns(table(spark, [])))) == set()


def test_turnless_conversations(spark):
    from pyspark.sql import functions as F

    rows = [(c, 0, "user", "x") for c in (101, 102, 103, 121)]
    out = trie.spliced(trie.turns(table(spark, rows)), F.lit(None).cast("long"), F.lit(2), 3)
    assert nodes(trie.prefix_trie(out)) == plain({c: [] for c in (101, 102, 103, 121)})


def test_query(spark, sf_dir):
    t = pq.read_table(f"{sf_dir}/conversations.parquet")
    data = list(zip(*[t[c].to_pylist() for c in ("conv_id", "turn", "role", "text")], strict=True))
    assert nodes(q.op13_prefix_trie(spark, sf_dir)) == plain(rebuilt(grouped(data)))
