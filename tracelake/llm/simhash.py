"""SimHash near-duplicates by anchor-point covering.

Texts become 64-bit fingerprints in Python over Arrow batches; fingerprints that differ in at most
``max_bits`` bits are linked. The 64 bits are cut into three blocks, so two linked fingerprints agree
in one block up to a single bit (4 bits over 3 blocks). In each block the anchors are the words of a
covering code: the first 15 bits hold a [15, 11] Hamming word, the other bits are free, so every block
lies within 1 bit of its home anchor. A fingerprint is sent to every anchor within covering radius plus
block threshold (1 + 1 = 2 bits), about 15 of 131,072 per block; at each anchor those at home are
compared with all that came. If x and y agree in a block up to one bit, y comes to the home of x.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, connected_components, discard, materialise

#: First bit and number of bits of each block.
BLOCKS = ((0, 21), (21, 21), (42, 22))
HAMMING_BITS = 15
RADIUS, BLOCK_THRESHOLD = 1, 1
MAX_BITS = 4
SHINGLE_WORDS = 4
#: Anchors that more fingerprints come to are cut into tiles, each pair of tiles a group of its own.
TILE = 20_000
#: Table of such anchors up to this many rows is broadcast.
MAX_BROADCAST_ANCHORS = 100_000
#: Pairs compared at a time.
CHUNK = 1 << 21


def hash_shingles(text: bytes, shingle: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``shingle`` words of lower-cased text, repeats included."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    n = max(1, len(words) - shingle + 1)
    last = min(shingle, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n], ends[last:])), np.uint64, n)


def simhash(text: bytes | None, shingle: int = SHINGLE_WORDS) -> int:
    """Fingerprint of a text; without words all bits are 0."""
    return fingerprint_of(hash_shingles(text or b"", shingle))


def fingerprint_of(h: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for part in range(0, len(h), 4096):
        bits = np.unpackbits(h[part : part + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fp`` of every row; ``fp`` holds the 64 bits as a signed number."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, fp long")


def error_patterns(n_bits: int, weight: int = RADIUS + BLOCK_THRESHOLD) -> list[np.ndarray]:
    """For each syndrome of the Hamming code, all patterns of at most ``weight`` (2 at most) of ``n_bits`` bits that have it.

    Column ``i`` of the parity check is ``i + 1`` for the Hamming bits and 0 for the free ones. XOR of a
    block with a pattern of its own syndrome gives an anchor.
    """
    column = [i + 1 if i < HAMMING_BITS else 0 for i in range(n_bits)]
    found: list[list[int]] = [[] for _ in range(HAMMING_BITS + 1)]
    found[0].append(0)
    for i in range(n_bits):
        found[column[i]].append(1 << i)
        if weight > 1:
            for j in range(i):
                found[column[i] ^ column[j]].append(1 << i | 1 << j)
    return [np.array(x, np.int64) for x in found]


def syndromes(block: np.ndarray) -> np.ndarray:
    out = np.zeros(len(block), np.int64)
    for i in range(HAMMING_BITS):
        out ^= np.where(block >> i & 1, i + 1, 0)
    return out


def to_anchors(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key of block and anchor, fingerprint, whether at home) for all anchors within reach."""
    for k, (first, n) in enumerate(BLOCKS):
        block = (fps >> np.uint64(first) & np.uint64((1 << n) - 1)).astype(np.int64)
        syndrome = syndromes(block)
        for s, patterns in enumerate(error_patterns(n)):
            own = syndrome == s
            anchors = (block[own][:, None] ^ patterns[None, :]).ravel()
            home = np.tile(patterns == (1 << (s - 1) if s else 0), int(own.sum()))
            yield anchors | k << 32, np.repeat(fps[own], len(patterns)), home


def replicate(distinct: DataFrame) -> DataFrame:
    """``anchor, fp, home`` for every distinct fingerprint and anchor within reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchors, fps, home in to_anchors(batch.column(0).to_numpy().view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(anchors), pa.array(fps.view(np.int64)), pa.array(home)], ["anchor", "fp", "home"])

    return distinct.select("fp").mapInArrow(run, "anchor long, fp long, home boolean")


def join_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of the sets of ``a[i]`` and ``b[i]``; ``root`` points at the smallest member."""
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root[:] = root[root]


def link_groups(group: np.ndarray, fps: np.ndarray, home: np.ndarray, visits: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among the rows of each group (rows sorted by group): fingerprints ``(a, b)``.

    Compares every row at home with every visitor of its group, a bounded number of pairs at a time,
    and gives each linked row one link to the first of its local component, so that links never
    outnumber rows. No connection is lost.
    """
    n = len(group)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.empty(0, int)
    sizes = np.diff(np.r_[starts, n])
    of = np.repeat(np.arange(len(starts)), sizes)
    visitor_rows = np.flatnonzero(visits)
    n_visitors = np.bincount(of[visitor_rows], minlength=len(starts))
    first_visitor = np.cumsum(n_visitors) - n_visitors
    homes = np.flatnonzero(home)
    root = np.arange(n)
    per = n_visitors[of[homes]]
    ends = np.cumsum(per)
    at = 0
    while at < len(homes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK)))
        rows, count = homes[at:to], per[at:to]
        a = np.repeat(rows, count)
        offset = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
        b = visitor_rows[np.repeat(first_visitor[of[rows]], count) + offset]
        close = np.bitwise_count(fps[a] ^ fps[b]) <= max_bits
        join_roots(root, a[close], b[close])
        at = to
    moved = np.flatnonzero(root != np.arange(n))
    moved = moved[fps[moved] != fps[root[moved]]]
    return fps[moved], fps[root[moved]]


def _compare(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; what belongs to the last group of a batch waits for the next."""
        names = ("anchor", "home_tile", "tile", "fp", "home", "visits")
        waiting = [np.empty(0, t) for t in (np.int64, np.int32, np.int32, np.int64, bool, bool)]

        def links(rows: list[np.ndarray]) -> pa.RecordBatch:
            anchor, home_tile, tile, fp, home, visits = rows
            change = np.ones(len(anchor), bool)
            change[1:] = (anchor[1:] != anchor[:-1]) | (home_tile[1:] != home_tile[:-1]) | (tile[1:] != tile[:-1])
            a, b = link_groups(np.cumsum(change), fp.view(np.uint64), home, visits, max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            got = [batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in names]
            rows = [np.concatenate(x) for x in zip(waiting, got)]
            if not len(rows[0]):
                continue
            same = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1]) & (rows[2] == rows[2][-1])
            cut = int(np.flatnonzero(same)[0])
            waiting = [x[cut:] for x in rows]
            if cut:
                yield links([x[:cut] for x in rows])
        if len(waiting[0]):
            yield links(waiting)

    return run


def linked(distinct: DataFrame, max_bits: int = MAX_BITS, tile: int = TILE) -> DataFrame:
    """Links ``(a, b)`` that connect all fingerprints of ``distinct(fp)`` within ``max_bits`` of each other.

    An anchor with more than ``tile`` fingerprints is cut by a hash into tiles; its homes and visitors
    are compared tile by tile, so that no task holds more than about two tiles. The links are written out.
    """
    if max_bits > 3 * (BLOCK_THRESHOLD + 1) - 2:
        raise ValueError(f"three blocks find at most {3 * (BLOCK_THRESHOLD + 1) - 2} differing bits")
    rows = materialise(replicate(distinct))
    hot = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > tile)
    hot = materialise(hot.select("anchor", F.ceil(F.col("n") / tile).cast("int").alias("tiles")))
    placed = rows.join(broadcast_if_small(hot, MAX_BROADCAST_ANCHORS), "anchor", "left")
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    cool = placed.filter("tiles is null").select("anchor", F.lit(0).alias("home_tile"), F.lit(0).alias("tile"), "fp", "home", F.lit(True).alias("visits"))
    visitors = placed.filter("tiles is not null").select("anchor", every.alias("home_tile"), own.alias("tile"), "fp", F.lit(False).alias("home"), F.lit(True).alias("visits"))
    homes = placed.filter("tiles is not null and home").select("anchor", own.alias("home_tile"), every.alias("tile"), "fp", F.lit(True).alias("home"), F.lit(False).alias("visits"))
    keys = ["anchor", "home_tile", "tile"]
    dealt = cool.union(visitors).union(homes).repartition(*keys).sortWithinPartitions(*keys)
    out = materialise(dealt.mapInArrow(_compare(max_bits), "a long, b long"))
    discard(rows, hot)
    return out


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
    tile: int = TILE,
) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id``.

    ``fingerprint`` is 16 lower-case hex digits; ``component_id`` the smallest id reachable over links
    of at most ``max_bits`` differing bits. Copies share a fingerprint and are collapsed before any
    comparison. Null, empty and blank texts have fingerprint zero and are linked like any other.
    Rows with a null id take part and get their component; an empty table gives an empty result.
    Other columns are not read.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, shingle))
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(linked(distinct, max_bits, tile))
    roots = distinct.join(roots.withColumnRenamed("node", "fp"), "fp")
    least = roots.groupBy("root").agg(F.min("least").alias("least_of_all"))
    found = materialise(roots.join(least, "root").select("fp", "least_of_all"))
    of = materialise(distinct.join(found, "fp", "left").select("fp", F.coalesce("least_of_all", "least").alias("component_id")))
    discard(distinct, found)
    hex_fp = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return prints.join(of, "fp").select("doc_id", hex_fp, "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that have the smallest id of their group of near copies, with all columns."""
    groups = near_duplicates(docs, id_col, text_col, **options)
    keep = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__keep_id")).distinct()
    return docs.join(keep, F.col(id_col).eqNullSafe(F.col("__keep_id")), "left_semi")
