"""Operator 10, SimHash near-dedup by segment-popcount embedding.

A fingerprint's 64 bits are cut into segments; the numbers of set bits in them are a point whose
Manhattan distance to another fingerprint's point never exceeds their Hamming distance. So a grid
range-join over these points, for all neighbours within the Manhattan distance, meets every pair
of linked fingerprints; the pairs that meet are then verified exactly. Only different fingerprints
are joined: copies fold into one row first, however many there are.

Two fingerprints that differ in at most ``reach`` bits agree in all bits of one of reach + 1 blocks of segments. So a
cell is a block's exact bits and the other segments' counts: a pair meets by the first block that
it agrees in, and the join grows with the input and not with its square. Each fingerprint looks up the cells within
reach that come after its own in one fixed order. A bitmap of the occupied cells with a fixed
greatest size drops look-ups of empty cells before the join; where it fills up, more look-ups are
shuffled and none is lost.

Texts of a Jaccard similarity of 0.8 differ in some ten of 64 bits, up to twenty, at which distance neither
bits nor counts select anything. So ``similar`` takes 24 fingerprints of a set of shingles, and each half of one is a table of
its own: sets whose halves differ in one bit at most meet there by the same cells, and their similarity is
verified. What no table brings together, ``jaccard`` finds by prefixes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common, found, jaccard, rolling
from tidemark.llm.components import components

SEGMENTS = 16
#: Fingerprints of a shingle set in ``similar``; each half of one is a table, its ``HALF`` segments hold 32 bits.
PRINTS, HALF = 24, 8
#: Sets that a scan task of ``near`` holds before it sends blocks, and bytes for each range of cells.
CHUNK_SETS, RANGE_BYTES = 1 << 14, 8 << 20
#: Sets of a cell that others are linked to, and pairs that a set keeps, those of the most tables: so a large group takes linear work.
LEADS, LINKS = 4, 8
_SALTS = rolling.mix(np.arange(1, PRINTS + 1, dtype=np.uint64))


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """The SimHash of a text's word shingles: a bit is set where over half the shingles' hashes set it."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    begins = np.append(0, ends[:-1])
    digest = xxhash.xxh64_intdigest
    n = len(words) - width + 1
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(begins[:n].tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)], "<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(id, bits) for every row: the fingerprint as a signed long. A null text has no words: zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", 4 << 20):
            prints = np.array([fingerprint(t, width, seed) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.record_batch([batch.column("id"), pa.array(prints.view(np.int64))], ["id", "bits"])

    rows = df.select(common.id_in(id_col).alias("id"), common.text_in(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, bits long")


def _cells(bits: np.ndarray) -> np.ndarray:
    """The point of set-bit counts, four bits to a segment, so that offsets can be added."""
    x = bits.view(np.uint64)
    three, one = np.uint64(0x3333333333333333), np.uint64(0x5555555555555555)
    x = x - ((x >> np.uint64(1)) & one)
    return (x & three) + ((x >> np.uint64(2)) & three)


def _blocks(reach: int, segments: int = SEGMENTS) -> list[range]:
    """reach + 1 runs of segments."""
    edges = [segments * k // (reach + 1) for k in range(reach + 2)]
    return [range(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _mask(block: range) -> int:
    return sum(15 << (4 * k) for k in block)


def _offsets(reach: int, block: range, segments: int = SEGMENTS) -> list[tuple[tuple[int, int], ...]]:
    """Moves of 1 to ``reach`` in Manhattan distance outside the block, one of each opposite pair."""
    level: set[tuple[tuple[int, int], ...]] = {()}
    found: set[tuple[tuple[int, int], ...]] = set()
    for _ in range(reach):
        grown = set()
        for move in level:
            for k in range(segments):
                for d in (-1, 1):
                    new = dict(move)
                    new[k] = new.get(k, 0) + d
                    if k not in block and abs(new[k]) > abs(dict(move).get(k, 0)):
                        grown.add(tuple(sorted(new.items())))
        level = grown
        found |= grown
    return sorted(m for m in found if m[-1][1] > 0)


def _keys(bits: np.ndarray, block: range) -> np.ndarray:
    """The cell: exact bits within the block, four-bit counts elsewhere (offsets can be added to these)."""
    mask = np.uint64(_mask(block))
    return (bits.view(np.uint64) & mask) | (_cells(bits) & ~mask)


def _tagged(keys: np.ndarray, block: range) -> np.ndarray:
    """Keys of different blocks kept apart; where two meet all the same, the exact check parts them."""
    return rolling.mix(keys) ^ rolling.mix(np.full(1, _mask(block), np.uint64))


def _look_up(bitmap, reach: int):
    blocks = [(block, _offsets(reach, block)) for block in _blocks(reach)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bitmap.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 14):
                bits = batch.column("bits").slice(at, 1 << 14).to_numpy(zero_copy_only=False)
                cells = _cells(bits)
                fields = [((cells >> np.uint64(4 * k)) & np.uint64(15)).astype(np.int8) for k in range(SEGMENTS)]
                for number, (block, moves) in enumerate(blocks):
                    keys = _keys(bits, block)
                    met = [(_tagged(keys, block), bits)]
                    for move in moves:
                        inside = np.ones(len(keys), bool)
                        for k, d in move:
                            inside &= (fields[k] + d >= 0) & (fields[k] + d <= 4)
                        inside = np.flatnonzero(inside)
                        target = _tagged(keys[inside] + np.uint64(sum(d << (4 * k) for k, d in move) % (1 << 64)), block)
                        hit = found.has(known, found.places(target, len(known)))
                        if hit.any():
                            met.append((target[hit], bits[inside[hit]]))
                    cell, a = (np.concatenate(x) for x in zip(*met, strict=True))
                    yield pa.record_batch([pa.array(cell.view(np.int64)), pa.array(a), pa.array(np.full(len(a), number, np.int32))], ["cell", "a", "block"])

    return run


def _own_cells(reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch.column("bits").to_numpy(zero_copy_only=False)
            for block in _blocks(reach):
                yield pa.record_batch([pa.array(_tagged(_keys(bits, block), block).view(np.int64)), pa.array(bits)], ["cell", "b"])

    return run


def links(distinct: DataFrame, reach: int = 2) -> DataFrame:
    """Pairs (u, v) of different fingerprints (column ``bits``, distinct rows) within ``reach`` bits.

    A null fingerprint has no links; an empty table has none.
    """
    distinct = distinct.filter(F.col("bits").isNotNull())
    bits = found.bitmap(
        distinct, (reach + 1) * distinct.count(),
        lambda batch: [_tagged(_keys(batch.column("bits").to_numpy(zero_copy_only=False), block), block) for block in _blocks(reach)],
    )
    bitmap = distinct.sparkSession.sparkContext.broadcast(bits)
    probes = distinct.mapInArrow(_look_up(bitmap, reach), "cell long, a long, block int")
    points = distinct.mapInArrow(_own_cells(reach), "cell long, b long")
    apart = F.col("a").bitwiseXOR(F.col("b"))
    masks = [_mask(block) - (1 << 64) * (_mask(block) >> 63) for block in _blocks(reach)]
    first = F.coalesce(*[F.when(apart.bitwiseAND(F.lit(mask)) == 0, F.lit(k)) for k, mask in enumerate(masks)])
    met = probes.join(points, "cell").filter((F.bit_count(apart) <= reach) & (F.col("a") != F.col("b")) & (F.col("block") == first))
    return met.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))


def hex_digits(bits: Column) -> Column:
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


def set_fingerprints(hashed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """PRINTS SimHashes for each set of shingle hashes, ``hashed[at[k] : at[k + 1]]``, in a row of the result."""
    out = np.zeros((len(at) - 1, PRINTS), "<u8")
    for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        counts = np.zeros(64 * PRINTS, np.int64)
        for c in range(a, b, 255):  # so many fit a byte
            mixed = rolling.mix(hashed[c : min(c + 255, b), None] ^ _SALTS).astype("<u8", copy=False)
            counts += np.add.reduce(np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
        out[k] = np.packbits(2 * counts > b - a, bitorder="little").view("<u8")
    return out


def _deal(parts: int):
    """Blocks (part, blob, size) of (key, half, table) for the sets of a chunk, once for each block of segments: both sets of a pair have its bits."""
    blocks = _blocks(1, HALF)

    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        key, halves = (np.concatenate(x) for x in zip(*held, strict=True))
        table = np.tile(np.arange(halves.shape[1], dtype=np.uint8), len(key))
        key, half = np.repeat(key, halves.shape[1]), halves.reshape(-1)
        for number, block in enumerate(blocks):
            tables = 2 * table + np.uint8(number)
            part = (rolling.mix((half & np.uint32(_mask(block))).astype(np.uint64) + (tables.astype(np.uint64) << np.uint64(40))) & np.uint64(parts - 1)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            edge = np.flatnonzero(np.append(True, part[order[1:]] != part[order[:-1]])).tolist()
            rows = []
            for a, b in zip(edge, [*edge[1:], len(order)], strict=True):
                own = order[a:b]
                raw = b"".join([key[own].astype("<i8").tobytes(), half[own].astype("<u4").tobytes(), tables[own].tobytes()])
                rows.append((int(part[own[0]]), pa.compress(raw, codec="zstd", asbytes=True), len(raw)))
            for k in range(0, len(rows), 64):
                part_, blobs, lengths = zip(*rows[k : k + 64], strict=True)
                yield pa.record_batch([pa.array(part_, pa.int32()), pa.array(blobs, pa.binary()), pa.array(lengths, pa.int64())], ["part", "blob", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_SETS):
                rows = batch.slice(at, CHUNK_SETS)
                halves = rolling.flat(rows.column("prints"))[0].view("<u4").reshape(rows.num_rows, 2 * PRINTS)
                held.append((rows.column("key").to_numpy(zero_copy_only=False), halves))
                if sum(len(k) for k, _ in held) >= CHUNK_SETS:
                    yield from flush(held)
                    held = []
        if held:
            yield from flush(held)

    return run


def _range_join(table: pa.Table) -> pa.Table:
    """Pairs (u, v) of sets whose halves in one table differ in at most one bit: v is one of the LEADS of a cell that u looks up.

    A set keeps LEADS pairs here, of the least mixed v, which a large group of near copies has mostly in common.
    """
    dealt = []
    for blob, size in zip(table.column("blob").to_pylist(), table.column("size").to_pylist(), strict=True):
        raw, m = pa.decompress(blob, decompressed_size=size, codec="zstd", asbytes=True), size // 13
        dealt.append((np.frombuffer(raw, "<i8", m), np.frombuffer(raw, "<u4", m, 8 * m), np.frombuffer(raw, np.uint8, m, 12 * m)))
    keys, halves, tables = (np.concatenate(x) for x in zip(*dealt, strict=True))
    us, vs = [], []
    for number, block in enumerate(_blocks(1, HALF)):
        of = np.flatnonzero(tables % 2 == number)
        bits = halves[of].astype(np.uint64)
        cells = _keys(bits, block) + (tables[of].astype(np.uint64) << np.uint64(40))
        order = np.lexsort((rolling.mix(keys[of].view(np.uint64)), cells))
        key, bits, cells = keys[of][order], bits[order], cells[order]
        begins = np.flatnonzero(np.append(True, cells[1:] != cells[:-1])[: len(cells)])
        ends, known = np.append(begins[1:], len(cells)), cells[begins]
        counts = _cells(bits)
        for move in [(), *_offsets(1, block, HALF)]:
            fits = np.ones(len(cells), bool)
            for k, d in move:
                field = ((counts >> np.uint64(4 * k)) & np.uint64(15)).astype(np.int8) + d
                fits &= (field >= 0) & (field <= 4)
            asks = np.flatnonzero(fits)
            target = cells[asks] + np.uint64(sum(d << (4 * k) for k, d in move))
            cell = np.minimum(np.searchsorted(known, target), max(0, len(known) - 1))
            hit = known[cell] == target
            asks, cell = asks[hit], cell[hit]
            for k in range(LEADS):
                lead = begins[cell] + k
                u, v = asks[lead < ends[cell]], lead[lead < ends[cell]]
                close = (np.bitwise_count(bits[u] ^ bits[v]) <= 1) & (key[u] != key[v])
                us.append(key[u[close]])
                vs.append(key[v[close]])
    u, v = np.concatenate(us), np.concatenate(vs)
    order = np.lexsort((rolling.mix(v.view(np.uint64)), u))
    u, v = u[order], v[order]
    new = np.append(True, (u[1:] != u[:-1]) | (v[1:] != v[:-1]))[: len(u)]
    u, v = u[new], v[new]
    first = np.searchsorted(u, u)
    kept = np.arange(len(u)) - first < LEADS
    return pa.table([pa.array(u[kept]), pa.array(v[kept])], ["u", "v"])


def near(sets: DataFrame) -> DataFrame:
    """Pairs (u < v) of the sets (key, prints; a row a key) that one of the tables brings together, to be verified."""
    parts = common.power_of_two(sets.count() * 4 * PRINTS * 13 / RANGE_BYTES, 64, 1 << 14)
    met = sets.mapInArrow(_deal(parts), "part int, blob binary, size long").groupBy("part").applyInArrow(_range_join, "u long, v long")
    often = met.groupBy("u", "v").agg((-F.count("*")).alias("n"))
    best = F.array_sort(F.collect_list(F.struct("n", F.xxhash64("v"), "v")))
    kept = often.groupBy("u").agg(F.slice(best, 1, LINKS).alias("kept")).select("u", F.explode("kept.v").alias("v"))
    return kept.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: tuple[int, int] = (4, 5)) -> DataFrame:
    """(id, component_id) for every row: linked by the Jaccard similarity of shingle sets instead of bits.

    Sets that a range join over their fingerprints' halves brings together are verified first. No
    fingerprint finds every similar pair, so sets that are then not in one component meet once more by
    prefixes (``jaccard``, with its edge cases): no link is lost.
    """
    return jaccard.near_duplicates(df, id_col, text_col, width, similarity, set_fingerprints, near)


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, reach: int = 2, seed: int = 42
) -> DataFrame:
    """(id, fingerprint, component_id) for every row.

    Fingerprints that differ in at most ``reach`` bits are linked; ``component_id`` is the smallest
    id that can be reached, the row's own included. A null text has no words, like an empty one:
    its fingerprint is zero, linked like any other. Rows that share an id keep their own rows. A
    null id is smaller than every other id and is returned as null, also as a component. An empty
    table gives an empty result.
    """
    docs = common.checkpointed(fingerprints(df, id_col, text_col, width, seed))
    distinct = docs.groupBy("bits").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    distinct = common.checkpointed(distinct)
    linked = components(links(distinct.select("bits"), reach))
    classes = distinct.join(linked.withColumnRenamed("node", "bits"), "bits", "left").withColumn("component", F.coalesce("component", "bits"))
    smallest = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = classes.join(smallest, "component").select("bits", "component_id", "n")
    return common.join_counted(docs, common.checkpointed(named), "bits", "id", docs.count()).select(
        common.id_out(F.col("id")).alias(id_col), hex_digits(F.col("bits")).alias("fingerprint"), common.id_out(F.col("component_id")).alias("component_id")
    )
