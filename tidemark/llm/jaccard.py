"""Near-duplicates by the exact Jaccard similarity of word shingles.

Two sets with a similarity of p/q or more share one of the first n - ceil(n * p / q) + 1 shingles
of each, in any one order of all shingles. So only these prefixes are shuffled, dealt by shingle;
sets that share a prefix shingle meet there, and pairs that no bound on sizes and positions rules
out are verified on whole sets. No pair is lost, whatever the order. Frequent shingles are ordered
last, so that few sets meet by them. Shingles and sets are known by 64-bit hashes.

Equal sets fold first. Then the sets of one shingle are verified against one of them only, which
joins a large group of near copies in linear work (the set of the least mixed key, so that a group has mostly the same one at every shingle). Each is also verified against the next two in an order of the shingle's
own: near copies that few of a group resemble still join it, again in linear work. All other pairs of a
shingle follow only where the two are not yet in one component, so one of each is outside the shingle's largest, and where the odd counts of their sketches leave it possible. Before whole sets move, the pair's sketches are compared: the
difference of these (shingles by 256 values of their hash) never exceeds that of the sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common, found, rolling
from tidemark.llm.components import components

#: Shingles that a scan task holds before it sends blocks or counts.
CHUNK_SHINGLES = 1 << 20
#: Input bytes for each range of shingles.
RANGE_BYTES = 16 << 20
#: Shingles ordered last: at most so many, each known to be in so many sets at least.
MOST_FREQUENT, FREQUENT = 1 << 18, 8
#: Members that each member of a shingle's meeting is verified against before all other pairs.
CHAIN = 2


#: Fingerprints of the sets of shingle hashes, given where each set begins: a row of 64-bit numbers for each.
Prints = Callable[[np.ndarray, np.ndarray], np.ndarray]


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every different shingle, sorted. A shorter text is one shingle, an empty one too."""
    raw, offsets = rolling.flat(texts)
    raw = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    begins, ends, first = rolling.word_bounds(raw, offsets)
    words = rolling.word_hashes(raw, begins, ends)
    counts = np.diff(first)
    whole = rolling.window_hashes(words, width)
    row = np.repeat(np.arange(len(counts)), counts)[: len(whole)]
    fits = np.arange(len(whole)) + width <= first[1:][row]
    rows, hashes = [row[fits]], [whole[fits]]
    for n in range(min(width, int(counts.min(initial=width)) + width)):
        short = np.flatnonzero(counts == n)
        rows.append(short)
        hashes.append(rolling.mix(rolling.window_hashes(words, n)[first[short]] + np.uint64(n)) if n else np.zeros(len(short), np.uint64))
    row, hashed = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((hashed, row))
    row, hashed = row[order], hashed[order]
    new = np.append(True, (row[1:] != row[:-1]) | (hashed[1:] != hashed[:-1]))[: len(row)]
    return row[new], hashed[new]


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice: its rows, all shingles, where each row's begin, and each row's key."""
    for batch in common.slices(batches, "text", 1 << 20):
        row, hashed = shingles(batch.column("text"), width)
        at = np.searchsorted(row, np.arange(batch.num_rows + 1))
        keys = [xxhash.xxh64_intdigest(hashed[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield batch, hashed, at, np.array(keys, np.uint64).view(np.int64)


def _keys(width: int, prints: Prints | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, hashed, at, keys in _sets(batches, width):
            own = prints(hashed, at) if prints else np.zeros((batch.num_rows, 0), np.uint64)
            cell = 256 * np.repeat(np.arange(batch.num_rows), np.diff(at)) + (hashed >> np.uint64(56)).astype(np.int64)
            counts = np.bincount(cell, minlength=256 * batch.num_rows)
            sketches = np.minimum(counts, 255).astype(np.uint8)  # cut off, two differ no more than before
            odd = np.packbits((counts & 1).astype(bool)).view(np.int64).reshape(-1, len(_ODD))
            columns = [batch.column("id"), pa.array(keys), pa.array(np.diff(at)), rolling.binary_rows(sketches, np.full(batch.num_rows, 256))]
            columns.append(rolling.binary_rows(own.reshape(-1), np.full(batch.num_rows, own.shape[1])))
            yield pa.record_batch([*columns, *(pa.array(np.ascontiguousarray(c)) for c in odd.T)], ["id", "key", "n", "sketch", "prints", *_ODD])

    return run


def _whole(width: int, wanted):
    """Keys and sets of the rows whose id a bitmap holds."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = wanted.value
        for batch in batches:
            hit = found.has(known, found.places(batch.column("id").to_numpy(zero_copy_only=False), len(known)))
            yield batch.filter(pa.array(hit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, hashed, at, keys in _sets(asked(batches), width):
            yield pa.record_batch([pa.array(keys), rolling.binary_rows(hashed, np.diff(at))], ["key", "shingles"])

    return run


def _often(width: int, chunk: int):
    """Shingles that two or more sets of a chunk hold, and how many do."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        unique, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.record_batch([pa.array(unique[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], ["h", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        known: set[int] = set()
        n = 0
        for _, hashed, at, keys in _sets(batches, width):
            for k, key in enumerate(keys.tolist()):
                if key not in known:
                    known.add(key)
                    held.append(hashed[at[k] : at[k + 1]])
                    n += len(held[-1])
            if n >= chunk:
                yield flush(held)
                held, known, n = [], set(), 0
        if held:
            yield flush(held)

    return run


def _prefixes(width: int, p: int, q: int, frequent, parts: int, chunk: int):
    """Blocks (part, blob, size) of the prefixes of the sets of a chunk."""

    def flush(sets: list[tuple[int, int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys, sizes = np.array([s[0] for s in sets], "<i8"), np.array([s[1] for s in sets], "<i4")
        at = np.repeat(np.arange(len(sets)), [len(s[2]) for s in sets])
        h, pos = np.concatenate([s[2] for s in sets]), np.concatenate([s[3] for s in sets])
        part = (h & np.uint64(parts - 1)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        at, h, pos, part = at[order], h[order], pos[order], part[order]
        edge = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist()
        rows = []
        for a, b in zip(edge, [*edge[1:], len(part)], strict=True):
            raw = b"".join([keys[at[a:b]].tobytes(), sizes[at[a:b]].tobytes(), pos[a:b].astype("<i4").tobytes(), h[a:b].astype("<u8").tobytes()])
            rows.append((int(part[a]), pa.compress(raw, codec="zstd", asbytes=True), len(raw)))
        for k in range(0, len(rows), 64):
            part_, blobs, lengths = zip(*rows[k : k + 64], strict=True)
            yield pa.record_batch([pa.array(part_, pa.int32()), pa.array(blobs, pa.binary()), pa.array(lengths, pa.int64())], ["part", "blob", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value  # sorted; with each one's rank
        sets: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        known: set[int] = set()
        n = 0
        for _, hashed, at, keys in _sets(batches, width):
            rank = np.zeros(len(hashed), np.int64)
            if len(often[0]):
                near = np.minimum(np.searchsorted(often[0], hashed), len(often[0]) - 1)
                rank = np.where(often[0][near] == hashed, often[1][near], 0)
            for k, key in enumerate(keys.tolist()):
                if key in known:
                    continue
                known.add(key)
                own, size = hashed[at[k] : at[k + 1]], int(at[k + 1] - at[k])
                most = size + (-p * size // q) + 1
                first = np.argsort(rank[at[k] : at[k + 1]], kind="stable")[:most]
                sets.append((key, size, own[first], np.arange(len(first))))
                n += len(first)
            if n >= chunk:
                yield from flush(sets)
                sets, known, n = [], set(), 0
        if sets:
            yield from flush(sets)

    return run


#: Which of a sketch's 256 counts are odd, as bits: two sets differ in at least as many shingles as bits.
_ODD = ("odd0", "odd1", "odd2", "odd3")
_MET = "meeting long, key long, n int, pos int, lead long, lead_n int, lead_pos int"


def _meet(p: int, q: int):
    def run(table: pa.Table) -> pa.Table:
        """The sets that meet in one range of shingles, with one of each meeting for all."""
        blocks = []
        for blob, size in zip(table.column("blob").to_pylist(), table.column("size").to_pylist(), strict=True):
            raw, m = pa.decompress(blob, decompressed_size=size, codec="zstd", asbytes=True), size // 24
            blocks.append((np.frombuffer(raw, "<i8", m), np.frombuffer(raw, "<i4", m, 8 * m), np.frombuffer(raw, "<i4", m, 12 * m), np.frombuffer(raw, "<u8", m, 16 * m)))
        key, n, pos, h = (np.concatenate(x) for x in zip(*blocks, strict=True))
        order = np.argsort(h)
        same = h[order[1:]] == h[order[:-1]]
        order = order[np.append(same, False) | np.append(False, same)]
        order = order[np.lexsort((key[order], n[order], h[order]))]
        key, n, pos, h = key[order], n[order], pos[order], h[order]
        one = np.append(True, (h[1:] != h[:-1]) | (key[1:] != key[:-1]))[: len(h)]
        key, n, pos, h = key[one], n[one], pos[one], h[one]
        # Sizes too far apart never match, so a meeting ends where the next size is out of reach.
        new = np.append(True, (h[1:] != h[:-1]) | (q * n[:-1].astype(np.int64) < p * n[1:].astype(np.int64)))[: len(h)]
        begins = np.flatnonzero(new)
        lengths = np.diff(np.append(begins, len(h)))
        kept = np.repeat(lengths > 1, lengths)
        key, n, pos, h, new = key[kept], n[kept], pos[kept], h[kept], new[kept]
        begins = np.flatnonzero(new)
        lengths = np.diff(np.append(begins, len(h)))
        meeting = np.repeat(rolling.mix(h[begins] + n[begins].astype(np.uint64)), lengths)
        drawn = np.lexsort((rolling.mix(key.view(np.uint64)), np.repeat(np.arange(len(begins)), lengths)))
        lead = np.repeat(drawn[begins], lengths)
        columns = [meeting.view(np.int64), key, n, pos, key[lead], n[lead], pos[lead]]
        return pa.table([pa.array(c) for c in columns], [c.split()[0] for c in _MET.split(", ")])

    return run


def _possible(p: int, q: int, n: Column, pos: Column, m: Column, at: Column, first: bool) -> Column:
    """Whether sets of ``n`` and ``m`` shingles that share the one at ``pos`` and ``at`` may be similar.

    With ``first``, whether they may be if no shingle before is shared: true of any two similar
    sets at the first of their meetings, so none are lost when all their meetings are looked at.
    """
    shared = F.least(n - pos, m - at)
    shared = shared if first else F.least(pos, at) + shared
    return ((p + q) * shared.cast("long") >= p * (n + m).cast("long")) & (q * F.least(n, m).cast("long") >= p * F.greatest(n, m).cast("long"))


def _similar(p: int, q: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            close = []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), "<u8") for s in (a, b))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                close.append((p + q) * shared >= p * (len(x) + len(y)))
            yield batch.select(["u", "v"]).filter(pa.array(close, pa.bool_()))

    return run


def _close(p: int, q: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (rolling.flat(batch.column(c))[0].reshape(-1, 256).astype(np.int16) for c in ("a", "b"))
            apart = np.abs(x - y).sum(axis=1, dtype=np.int64)
            yield batch.select(["u", "v"]).filter(pa.array((p + q) * apart <= (q - p) * batch.column("n").to_numpy()))

    return run


def _verified(pairs: DataFrame, rows: DataFrame, keys: DataFrame, width: int, p: int, q: int) -> DataFrame:
    """The pairs (u, v) of keys whose whole sets are similar."""
    sketches = keys.select("key", "n", "sketch").dropDuplicates(["key"])
    one, other = (sketches.select(F.col("key").alias(k), F.col("sketch").alias(s), F.col("n").alias(f"n_{s}")) for k, s in (("u", "a"), ("v", "b")))
    both = pairs.join(one, "u").join(other, "v").select("u", "v", "a", "b", (F.col("n_a") + F.col("n_b")).alias("n"))
    pairs = common.checkpointed(both.mapInArrow(_close(p, q), "u long, v long"))
    asked = pairs.select(F.col("u").alias("key")).union(pairs.select(F.col("v").alias("key"))).distinct()
    ids = keys.join(asked, "key", "left_semi").groupBy("key").agg(F.min("id").alias("id")).select("id").distinct()
    ids = common.checkpointed(ids)
    wanted = rows.sparkSession.sparkContext.broadcast(found.bitmap(ids, ids.count(), lambda batch: [batch.column("id").to_numpy(zero_copy_only=False)]))
    whole = rows.mapInArrow(_whole(width, wanted), "key long, shingles binary").join(asked, "key", "left_semi").dropDuplicates(["key"])
    whole = common.checkpointed(whole)
    one, other = (whole.select(F.col("key").alias(k), F.col("shingles").alias(s)) for k, s in (("u", "a"), ("v", "b")))
    return pairs.join(one, "u").join(other, "v").select("u", "v", "a", "b").mapInArrow(_similar(p, q), "u long, v long")


def _across(met: DataFrame, links: DataFrame, least: int = 3) -> DataFrame:
    """Members of the meetings of ``least`` or more that hold several components, with the meeting's largest as ``main``."""
    named = components(links).withColumnRenamed("node", "key")
    members = met.join(named, "key", "left").withColumn("component", F.coalesce("component", "key"))
    parts = members.groupBy("meeting", "component").agg(F.count("*").alias("members"))
    whole = parts.groupBy("meeting").agg(F.max(F.struct("members", "component")).alias("most"), F.count("*").alias("parts"), F.sum("members").alias("members"))
    open_ = whole.filter((F.col("parts") > 1) & (F.col("members") >= least)).select("meeting", F.col("most.component").alias("main"))
    return common.checkpointed(members.join(open_, "meeting"))


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: tuple[int, int] = (4, 5), prints: Prints | None = None, near: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """(id, component_id) for every row.

    Rows whose sets of ``width``-word shingles have a Jaccard similarity of ``similarity`` (a
    fraction) or more are linked; words are runs without ASCII white space, in ASCII lower case. A
    text of fewer words is one shingle; a null text has no words, like an empty one, and these are
    alike. ``component_id`` is the smallest id that can be reached, the row's own included. Rows
    that share an id keep their own rows. A null id is smaller than every other id and is returned
    as null, also as a component. An empty table gives an empty result.

    ``near`` names pairs (u < v) of sets, by their ``prints``, that are verified before any others; prefixes then
    bring together only sets that these have not put into one component. The result is the same without.
    """
    p, q = similarity
    spark = df.sparkSession
    rows = df.select(common.id_in(id_col).alias("id"), common.text_in(text_col).alias("text"))
    keys = common.checkpointed(rows.mapInArrow(_keys(width, prints), "id long, key long, n long, sketch binary, prints binary, " + ", ".join(f"{c} long" for c in _ODD)))
    tried = links = spark.createDataFrame([], "u long, v long")
    if near:
        tried = common.checkpointed(near(keys.select("key", "prints").dropDuplicates(["key"])))
        links = common.checkpointed(_verified(tried, rows, keys, width, p, q))

    counted = rows.mapInArrow(_often(width, CHUNK_SHINGLES), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    often = counted.filter(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).toArrow()
    hashes, n = often.column("h").to_numpy().astype(np.int64).view(np.uint64), often.column("n").to_numpy().astype(np.int64)
    order = np.argsort(hashes)
    frequent = spark.sparkContext.broadcast((hashes[order], n[order]))
    parts = common.power_of_two(common.plan_bytes(df) / RANGE_BYTES, 16, 1 << 14)
    sent = rows.mapInArrow(_prefixes(width, p, q, frequent, parts, CHUNK_SHINGLES), "part int, blob binary, size long")
    met = common.checkpointed(sent.groupBy("part").applyInArrow(_meet(p, q), _MET))

    ends = [F.least("key", "other").alias("u"), F.greatest("key", "other").alias("v")]
    members = _across(met, links, 2)
    stars = members.withColumnRenamed("lead", "other").filter(F.col("key") != F.col("other"))
    stars = stars.filter(_possible(p, q, F.col("n"), F.col("pos"), F.col("lead_n"), F.col("lead_pos"), False))
    order = Window.partitionBy("meeting").orderBy(F.xxhash64("key", "meeting"), "key")
    ahead = [F.lead(F.struct("key", "n", "pos", "component"), k).over(order) for k in range(1, CHAIN + 1)]
    chain = members.withColumn("ahead", F.array(*ahead)).withColumn("next", F.explode("ahead"))
    chain = chain.filter(F.col("component") != F.col("next.component"))
    chain = chain.filter(_possible(p, q, F.col("n"), F.col("pos"), F.col("next.n"), F.col("next.pos"), False)).withColumn("other", F.col("next.key"))
    few = common.checkpointed(stars.select(*ends).union(chain.select(*ends)).distinct().join(tried, ["u", "v"], "left_anti"))
    links = common.checkpointed(links.union(_verified(few, rows, keys, width, p, q)))

    members = _across(members.select("meeting", "key", "n", "pos"), links)
    members = common.checkpointed(members.join(keys.select("key", *_ODD).dropDuplicates(["key"]), "key"))
    renamed = {"key": "other", "n": "m", "pos": "at", "component": "apart"} | {c: f"{c}_" for c in _ODD}
    others = members.select("meeting", *[F.col(a).alias(b) for a, b in renamed.items()])
    apart = (F.col("component") != F.col("apart")) & ((F.col("apart") == F.col("main")) | (F.col("key") < F.col("other")))
    apart &= _possible(p, q, F.col("n"), F.col("pos"), F.col("m"), F.col("at"), True)
    differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_"))) for c in _ODD), F.lit(0))
    apart &= (p + q) * differ <= (q - p) * (F.col("n") + F.col("m"))
    rest = members.filter(F.col("component") != F.col("main")).join(others, "meeting").filter(apart).select(*ends).distinct()
    rest = common.checkpointed(rest.join(tried.union(few), ["u", "v"], "left_anti"))
    links = links.union(_verified(rest, rows, keys, width, p, q))

    named = components(links).withColumnRenamed("node", "key")
    per_key = keys.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n")).join(named, "key", "left")
    per_key = common.checkpointed(per_key.withColumn("component", F.coalesce("component", "key")))
    smallest = common.checkpointed(per_key.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n")))
    classes = common.join_counted(per_key.select("key", "component", F.col("n").alias("rows")), smallest, "component", "key", per_key.count())
    classes = common.checkpointed(classes.select("key", "component_id", F.col("rows").alias("n")))
    out = common.join_counted(keys.select("id", "key"), classes, "key", "id", keys.count())
    return out.select(common.id_out(F.col("id")).alias(id_col), common.id_out(F.col("component_id")).alias("component_id"))
