"""Removal of repeated passages with suffix arrays that are sharded by content.

A passage counts as repeated if a string of ``length`` bytes starts at two places or more, in any
documents. Shards must bring equal strings together, so each string goes by the smallest hash of a
16-byte gram inside it, its anchor: equal strings have equal anchors at equal offsets. Neighbouring
strings share an anchor and travel as one context, and a context stands for its copies in all
documents. An anchor seen once proves its strings unique; if all contexts of an anchor are equal, by length and
128 bits of hash, their strings are repeated throughout. The others are laid out in shards, sorted by
induced sorting, and permuted common prefixes tell which strings meet a neighbour of ``length`` bytes or more.
Before the sort a sieve drops strings whose grams at the start, middle and end no other string of the anchor has.
An anchor with very many contexts is dealt anew by further anchors, so that every shard is small.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, discard, materialise
from .suffix_array import permuted_lcp, suffix_array

LENGTH = 200
GRAM = 16
#: Bytes of text hashed at a time, and bytes of contexts in a suffix array.
TILE_BYTES = 2 << 20
SHARD_BYTES = 1 << 20
#: The contexts of an anchor that has more different ones are split by further anchors before they are sorted.
MAX_CONTEXTS = 20_000
#: So many times by other gram hashes; after that each string is a context of its own.
RESEEDED = 2
MAX_BROADCAST = 100_000
#: Columns of a context that stands for its copies.
PART = "anchor long, d1 long, d2 long, n int, context binary"


def _grams(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the 16 bytes at each place."""
    n = len(data) - GRAM + 1
    words = np.empty(n + 8, np.uint64)
    for o in range(8):
        part = data[o : o + (len(data) - o) // 8 * 8].view("<u8")
        words[o::8] = part[: len(words[o::8])]
    h = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += words[8 : n + 8] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def contexts(data: np.ndarray, length: int = LENGTH, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, number of starts, anchor hash) of each run of strings with one anchor place; ``seed`` gives other anchors."""
    n = len(data) - length + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    h = _grams(data)
    if seed:
        h = (h ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    # The place in the low half makes the leftmost of equal hashes the smallest.
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width, reach = length - GRAM + 1, 1
    while 2 * reach <= width:
        key = np.minimum(key[: len(key) - reach], key[reach:])
        reach *= 2
    if width > reach:
        key = np.minimum(key[: len(key) - (width - reach)], key[width - reach :])
    place = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return first, np.diff(np.r_[first, n]), h[place[first]]


def _tiles(data: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    """Overlapping pieces of a long text; every string lies in exactly one."""
    step = max(TILE_BYTES, length)
    for at in range(0, max(1, len(data) - length + 1), step):
        yield at, data[at : at + step + length - 1]


def _mark(text: bytes) -> int:
    return zlib.crc32(text)


def _digests(pieces: Iterator[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of the 128-bit hash of each piece."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, pieces)), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def occurrences(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Contexts of all documents of ``docs(doc_id, text binary)``: ``doc_id, mark, start, n, anchor, d1, d2``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(text) < length:
                    continue
                mark = _mark(text)
                for at, piece in _tiles(text, length):
                    first, n, anchor = contexts(np.frombuffer(piece, np.uint8), length)
                    ends = (first + n + length - 1).tolist()
                    d1, d2 = _digests(piece[a:b] for a, b in zip(first.tolist(), ends))
                    for column, value in zip(out, ((doc_id, mark, len(first)), first + at, n, anchor.view(np.int64), d1, d2)):
                        column.append(value)
            if not out[0]:
                continue
            counts = [x[2] for x in out[0]]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in out[0]], batch.column(0).type).take(pa.array(np.repeat(np.arange(len(counts)), counts))),
                    pa.array(np.repeat(np.array([x[1] for x in out[0]], np.int64), counts)),
                    *(pa.array(np.concatenate(x), kind) for x, kind in zip(out[1:], kinds)),
                ],
                ["doc_id", "mark", "start", "n", "anchor", "d1", "d2"],
            )

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, mark long, start int, n int, anchor long, d1 long, d2 long")


def _bytes_of(located: DataFrame, length: int) -> DataFrame:
    """``anchor, d1, d2, n, context`` for rows with a text and a list of ``(start, n, anchor, d1, d2)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(text, r) for text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in places]
            if rows:
                numbers = [pa.array([r[c] for _, r in rows], kind) for c, kind in (("anchor", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("n", pa.int32()))]
                pieces = pa.array([t[r["start"] : r["start"] + r["n"] + length - 1] for t, r in rows], pa.binary())
                yield pa.RecordBatch.from_arrays([*numbers, pieces], ["anchor", "d1", "d2", "n", "context"])

    return located.mapInArrow(run, PART)


def repeated_starts(parts: list[bytes], copies: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each context, which of its strings are repeated, by one suffix array over all contexts.

    Only the strings that a context owns count as places: contexts overlap in their documents, so what
    lies beyond belongs to a neighbour. A string of a context that stands for several copies is repeated.
    """
    sizes = np.array([len(p) + 1 for p in parts])
    begins = np.cumsum(sizes) - sizes
    joined = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.int64) + 2
    joined[begins + sizes - 1] = 1  # ends of contexts
    text = np.r_[joined, 0]
    sa = suffix_array(text)
    common = permuted_lcp(text, sa)[sa]
    owner = np.repeat(np.arange(len(parts)), sizes)
    own = np.zeros(len(text), bool)
    own[:-1] = np.arange(len(joined)) - begins[owner] <= sizes[owner] - 1 - length
    at = np.flatnonzero(own[sa])
    again = np.zeros(len(text), bool)
    if len(at) > 1:
        # The common prefix of two owned places is the least one on the way between them.
        least = np.minimum.reduceat(common, np.r_[0, at[:-1] + 1, at[-1] + 1][: len(at) + (at[-1] + 1 < len(common))])[1 : len(at)]
        equal = least >= length
        again[sa[at[1:][equal]]] = True
        again[sa[at[:-1][equal]]] = True
    again[:-1] |= copies[owner] > 1
    return [again[b : b + s - length] for b, s in zip(begins, sizes)]


def _sieve(anchors: list[int], parts: list[bytes], length: int) -> list[tuple[int, int]]:
    """Range of starts of each context outside of which no string can have an equal; (0, 0) for none."""
    sizes = np.array([len(p) for p in parts])
    begins = np.cumsum(sizes) - sizes
    grams = _grams(np.frombuffer(b"".join(parts), np.uint8))
    n = sizes - length + 1
    owner = np.repeat(np.arange(len(parts)), n)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    at = begins[owner] + within
    last = length - GRAM
    key = np.array(anchors, np.int64).view(np.uint64)[owner]
    for offset in (0, last // 2, last):
        key = (key ^ grams[at + offset]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    order = np.argsort(key)
    ordered = key[order]
    equal = ordered[1:] == ordered[:-1]
    again = np.r_[False, equal] | np.r_[equal, False]
    maybe = np.empty(len(key), bool)
    maybe[order] = again
    first = np.full(len(parts), np.iinfo(np.int64).max)
    final = np.full(len(parts), -1)
    np.minimum.at(first, owner[maybe], within[maybe])
    np.maximum.at(final, owner[maybe], within[maybe])
    return [(a, b + 1) if b >= 0 else (0, 0) for a, b in zip(first.tolist(), final.tolist())]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _sort_shards(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor; a shard is some whole anchors, about ``SHARD_BYTES`` together."""

        def solve(rows: list[tuple]) -> pa.RecordBatch:
            found = [(*r[:3], 0, len(r[3]) - length + 1) for r in rows if r[4] > 1]
            ranges = _sieve([r[0] for r in rows], [r[3] for r in rows], length)
            left = [(r, a, b) for r, (a, b) in zip(rows, ranges) if b]
            if any(r[4] == 1 for r, _, _ in left):
                flags = repeated_starts([r[3][a : b + length - 1] for r, a, b in left], np.array([r[4] for r, _, _ in left]), length)
                found += [(*r[:3], a + lo, a + hi) for (r, a, _), f in zip(left, flags) if r[4] == 1 for lo, hi in _runs(f)]
            columns = zip(*found) if found else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["anchor", "d1", "d2", "lo", "hi"])

        waiting: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if size >= SHARD_BYTES and row[0] != waiting[-1][0]:
                    yield solve(waiting)
                    waiting, size = [], 0
                waiting.append(row)
                size += len(row[3])
        if waiting:
            yield solve(waiting)

    return run


def _split(length: int, level: int):
    """Contexts cut anew by the anchors of a level: ``(anchor, d1, d2)`` of the old one, ``at`` in it, and the new one's columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                rows = batch.slice(begin, 500).to_pylist()
                old, pieces, numbers = [], [], []
                for r in rows:
                    data = r["context"]
                    if level > RESEEDED:
                        first = np.arange(r["n"])
                        n = np.ones(r["n"], np.int64)
                        anchor = np.array([xxhash.xxh64_intdigest(data[i : i + length]) for i in range(r["n"])], np.uint64)
                    else:
                        first, n, anchor = contexts(np.frombuffer(data, np.uint8), length, level)
                    # Strings of different anchors stay apart.
                    anchor = ((anchor ^ np.uint64(r["anchor"] & (1 << 64) - 1)) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                    for f, k, a in zip(first.tolist(), n.tolist(), anchor.tolist()):
                        old.append((r["anchor"], r["d1"], r["d2"], f))
                        pieces.append(data[f : f + k + length - 1])
                        numbers.append((a, k, r["copies"]))
                if not old:
                    continue
                d1, d2 = _digests(iter(pieces))
                anchor, n, copies = zip(*numbers)
                columns = [pa.array(c, k) for c, k in zip(zip(*old), (pa.int64(), pa.int64(), pa.int64(), pa.int32()))]
                columns += [pa.array(anchor, pa.int64()), pa.array(d1), pa.array(d2), pa.array(n, pa.int32()), pa.array(pieces, pa.binary()), pa.array(copies, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["old_anchor", "old_d1", "old_d2", "at", "anchor", "d1", "d2", "n", "context", "copies"])

    return run


CONTEXT = ["anchor", "d1", "d2"]


def solve(parts: DataFrame, length: int, max_contexts: int, level: int = 0) -> DataFrame:
    """Repeated starts ``anchor, d1, d2, lo, hi`` of the contexts ``parts(anchor, d1, d2, n, context, copies)``, written out.

    Anchors with few contexts are sorted in shards. The contexts of any other are cut at the anchors of the next level,
    where equal strings again meet; at the last level every string is a context.
    """
    counts = parts.groupBy("anchor").agg(F.count(F.lit(1)).alias("__n"))
    hot = materialise(counts.filter(F.col("__n") > max_contexts).select("anchor"))
    any_hot = level <= RESEEDED and hot.limit(1).count() > 0
    cool = parts.join(broadcast_if_small(hot, MAX_BROADCAST), "anchor", "left_anti") if any_hot else parts
    dealt = cool.select("anchor", "d1", "d2", "context", "copies").repartition("anchor").sortWithinPartitions("anchor")
    solved = dealt.mapInArrow(_sort_shards(length), "anchor long, d1 long, d2 long, lo int, hi int")
    if any_hot:
        many = parts.join(broadcast_if_small(hot, MAX_BROADCAST), "anchor", "left_semi").select("anchor", "d1", "d2", "n", "context", "copies")
        old = "old_anchor long, old_d1 long, old_d2 long, at int"
        cut = materialise(many.mapInArrow(_split(length, level + 1), f"{old}, {PART}, copies long"))
        inner = materialise(cut.groupBy("anchor", "d1", "d2", "n", "context").agg(F.sum("copies").alias("copies")))
        found = solve(inner, length, max_contexts, level + 1)
        back = cut.select("old_anchor", "old_d1", "old_d2", "at", *CONTEXT).join(found, CONTEXT)
        names = [F.col(f"old_{c}").alias(c) for c in CONTEXT]
        solved = solved.union(back.select(*names, (F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi")).alias("hi")))
        out = materialise(solved)
        discard(cut, inner, found, hot)
        return out
    return materialise(solved)


def repeated_ranges(docs: DataFrame, length: int = LENGTH, max_contexts: int = MAX_CONTEXTS) -> DataFrame:
    """Ranges of starts of repeated strings: ``doc_id, mark, lo, hi`` for ``docs(doc_id, text binary)``."""
    found = occurrences(docs, length)
    ends = [f(c).alias(f"{name}_{c}") for c in ("d1", "d2", "n") for f, name in ((F.min, "least"), (F.max, "most"))]
    stats = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("seen"), *ends)
    equal = F.lit(True)
    for c in ("d1", "d2", "n"):
        equal = equal & (F.col(f"least_{c}") == F.col(f"most_{c}"))
    # Written, so that Spark can split a hot anchor where occurrences meet their anchor's row.
    stats = materialise(stats.filter("seen > 1").select("anchor", (~equal).alias("contested")))
    shared = materialise(found.join(stats, "anchor"))

    places = shared.filter("contested").groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "n", "anchor", "d1", "d2")).alias("places"))
    marked = docs.withColumn("mark", F.crc32("text"))
    same_row = marked["doc_id"].eqNullSafe(places["doc_id"]) & (marked["mark"] == places["mark"])
    parts = _bytes_of(marked.join(places, same_row).select("text", "places"), length)
    parts = materialise(parts.groupBy("anchor", "d1", "d2", "n", "context").agg(F.count(F.lit(1)).alias("copies")))
    solved = solve(parts, length, max_contexts)
    discard(parts, stats)
    contested = shared.filter("contested").join(solved, CONTEXT)
    contested = contested.select("doc_id", "mark", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi"))
    plain = shared.filter("not contested").select("doc_id", "mark", F.col("start").alias("lo"), (F.col("start") + F.col("n")).alias("hi"))
    return plain.union(contested)


def collapsed(rows: DataFrame) -> DataFrame:
    """``doc_id, text, copies``: rows that share id and text as one row with their number.

    Only rows whose id is repeated are compared, byte by byte, and combined before they are shuffled; where no id is, the rows go on
    as they are.
    """
    again = materialise(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select(F.col("doc_id").alias("__id")))
    if not again.limit(1).count():
        discard(again)
        return rows.withColumn("copies", F.lit(1).cast("long"))
    same = F.col("doc_id").eqNullSafe(F.col("__id"))
    many = rows.join(again, same, "left_semi").groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("copies"))
    return materialise(rows.join(again, same, "left_anti").withColumn("copies", F.lit(1).cast("long")).union(many))


def _cut(text: bytes, ranges: list[dict], length: int) -> tuple[bytes, int]:
    """What is left of a text, and the number of maximal removed runs."""
    if not ranges:
        return text, 0
    lo = np.array([r["lo"] for r in ranges], np.int64)
    hi = np.array([r["hi"] for r in ranges], np.int64) + length - 1
    change = np.bincount(lo, minlength=len(text) + 1)[: len(text) + 1] - np.bincount(hi, minlength=len(text) + 1)[: len(text) + 1]
    gone = np.cumsum(change)[:-1] > 0
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), len(_runs(gone))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, max_contexts: int = MAX_CONTEXTS, with_text: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, if asked for, ``kept`` (bytes).

    Every byte under a string of ``length`` bytes that also starts anywhere else, in the same document
    or another, is removed; strings are judged on the input. Null counts as empty. Texts shorter than
    ``length`` lose nothing. Repeated rows are places of their own, so all lose all their strings; they are
    searched as one row, however many they are.
    Rows with one id but different texts are told apart by a checksum. An empty table gives an empty
    result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    once = collapsed(rows)
    ranges = repeated_ranges(once.select("doc_id", "text"), length, max_contexts)
    # All strings of a text that has copies under its own id are repeated.
    whole = once.filter((F.col("copies") > 1) & (F.length("text") >= length)).select("doc_id", F.crc32("text").alias("mark"), F.lit(0).alias("lo"), (F.length("text") - length + 1).alias("hi"))
    ranges = ranges.union(whole).groupBy("doc_id", "mark").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    marked = rows.withColumn("mark", F.crc32("text"))
    same_row = marked["doc_id"].eqNullSafe(ranges["doc_id"]) & (marked["mark"] == ranges["mark"])
    located = marked.join(ranges, same_row, "left").select(marked["doc_id"], "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_bytes, n_spans = [], [], []
            for text, where in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                left, spans = _cut(text, where or [], length)
                kept.append(left)
                n_bytes.append(len(text))
                n_spans.append(spans)
            columns = [
                batch.column(0),
                pa.array(n_bytes, pa.int64()),
                pa.array([n - len(k) for n, k in zip(n_bytes, kept)], pa.int64()),
                pa.array(n_spans, pa.int64()),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            ]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return located.mapInArrow(run, schema + ", kept binary" * with_text)
