"""Alignment of two tokenizers' ids over a corpus, with pair counts behind minimal perfect hashes.

A first pass over the documents aligns both token rows of each text and hands on, for each batch of documents, which
id pairs it holds and in how many documents. The distinct pairs of each bucket of A ids get a minimal perfect hash, and
counts are dense vectors indexed by it, summed as a tree: batch by batch into the vector of a branch, then the
branches of a bucket. A bucket has at most its A ids times all B ids, whatever the size of the corpus. Each batch
asks for the counts of its own pairs; every slot is verified by the key it holds. A second pass aligns the documents
again and looks the counts up.

Rows that belong together meet in one partition in sorted order and are read one after another, so no group is held
whole: a bucket's table and one batch's pairs are all that a task keeps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .packing import parts
from .units import byte_bpe, cut, pieces, ragged

#: Bits of a B id in the key of a pair.
B_BITS = 15
BUCKETS = 256
#: Branches of the tree of sums under each bucket, at least, and batches to a branch.
BRANCHES, BATCHES_A_BRANCH = 4, 20_000
#: Documents of at most so many bytes go to batches of so many rows; longer ones are batches of their own.
BATCH_ROWS = ((8 << 10, 512), (128 << 10, 32))
#: Groups with more links are counted by their distinct ids.
DENSE = 256


class PerfectHash:
    """Minimal perfect hash of distinct numbers by levels of bits.

    At each level the keys that are left are dealt over twice as many places; those alone at their place set its bit, the rest go
    on. The number of a key is the rank of its bit.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, before = [], 0
        for bits in levels:
            self.ranks.append(np.cumsum(bits) - 1 + before)
            before += int(bits.sum())

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        x = keys.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return ((x ^ x >> np.uint64(31)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys):
            at = cls.place(keys, len(levels), 2 * len(keys))
            bits = np.bincount(at, minlength=2 * len(keys)) == 1
            levels.append(bits)
            keys = keys[~bits[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key; a number that was not hashed may get -1 or that of another."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            at = self.place(keys[todo], level, len(bits))
            hit = bits[at]
            out[todo[hit]] = ranks[at[hit]]
            todo = todo[~hit]
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], "<i8")
        return sizes.tobytes() + b"".join(np.packbits(bits).tobytes() for bits in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, "<i8", 1)[0])
        sizes, at, levels = np.frombuffer(data, "<i8", n, 8).tolist(), 8 + 8 * n, []
        for size in sizes:
            width = (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, width, at), count=size).astype(bool))
            at += width
        return cls(levels)


def merged(comb: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and the sum of their weights."""
    if not len(comb):
        return comb, weight
    order = np.argsort(comb, kind="stable")
    comb, weight = comb[order], weight[order]
    at = np.flatnonzero(np.r_[True, comb[1:] != comb[:-1]])
    return comb[at], np.add.reduceat(weight, at)


class Lexicon:
    """Alignment of units, kept from one part of a partition to the next; it starts anew when it has too many.

    Per unit: whether both tokenizers give its bytes back, numbers of ids, groups and links, its id pairs with the
    number of links of each, and its groups as text.
    """

    MOST = 500_000

    def __init__(self, ranks_path: str, pieces_path: str, with_text: bool):
        self.a, self.b, self.with_text = byte_bpe(ranks_path), pieces(pieces_path), with_text
        self.b_blob = np.frombuffer(b"".join(self.b.bytes), np.uint8)
        self.b_at = np.cumsum(self.b.length) - self.b.length
        if len(self.b.bytes) > 1 << B_BITS:
            raise ValueError("B has more ids than the key of a pair holds")
        if with_text:
            self.names = [np.array([f"{i}{end}" for i in range(n)], object) for n, end in ((len(self.a.bytes), ","), (len(self.a.bytes), "|"), (len(self.b.bytes), ","), (len(self.b.bytes), ";"))]
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.ok = np.empty(0, bool)
        self.sums = np.empty((0, 4), np.int64)
        self.keys, self.links = np.empty(0, np.uint32), np.empty(0, np.int64)
        self.begin, self.count = np.empty(0, np.int64), np.empty(0, np.int64)
        self.texts: list[str] = []

    def look_up(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(code of each unit, where each text's units begin and one more entry)."""
        if len(self.code) > self.MOST:
            self.clear()
        units = cut(texts, own_first=False)
        get = self.code.get
        known = np.array([get(s, -1) for s in units.strings], np.int64)
        new = np.flatnonzero((known < 0) & units.used)
        names = [units.strings[i] for i in new.tolist()]
        if names:
            self.learn(names, units.clean[new])
        known[new] = np.arange(len(new)) + len(self.code)
        self.code.update(zip(names, known[new].tolist()))
        return known[units.codes], units.starts

    def learn(self, names: list[str], clean: np.ndarray) -> None:
        spaced = [" " + s for s in names]
        raw = pa.array(spaced, pa.string()).cast(pa.binary())
        data = np.frombuffer(raw.buffers()[2], np.uint8)
        size = np.diff(np.frombuffer(raw.buffers()[1], np.int32)).astype(np.int64)
        a, na = self.a.encode(spaced, clean)
        b, nb = self.b.encode(names)
        n = len(names)
        of_a, of_b = np.repeat(np.arange(n), na), np.repeat(np.arange(n), nb)
        # A's ids always give their text back; B's are held against it byte by byte.
        ok = (np.bincount(of_a, self.a.length[a], n) == size) & (np.bincount(of_b, self.b.length[b], n) == size)
        good_b, good_bytes = ok[of_b], np.repeat(ok, size)
        back = self.b_blob[ragged(self.b_at[b[good_b]], self.b.length[b[good_b]])]
        ok &= np.bincount(np.repeat(np.arange(n), size)[good_bytes], back != data[good_bytes], n) == 0
        a, b, of_a, of_b = a[ok[of_a]], b[ok[of_b]], of_a[ok[of_a]], of_b[ok[of_b]]
        end_a, end_b = np.cumsum(self.a.length[a]), np.cumsum(self.b.length[b])
        last_a, last_b = np.isin(end_a, end_b, assume_unique=True), np.isin(end_b, end_a, assume_unique=True)
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        groups = int(last_a.sum())
        of_group = of_a[last_a]
        per_a, per_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        first_a, first_b = np.cumsum(per_a) - per_a, np.cumsum(per_b) - per_b
        product = per_a * per_b
        sums = np.stack([np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n), np.bincount(of_group, minlength=n), np.bincount(of_group, product, n).astype(np.int64)], 1)
        a64, b64 = a.astype(np.uint64) << np.uint64(B_BITS), b.astype(np.uint64)
        few = np.flatnonzero(product <= DENSE)
        k = ragged(np.zeros(len(few), np.int64), product[few])
        at = np.repeat(few, product[few])
        pairs = a64[first_a[at] + k // per_b[at]] | b64[first_b[at] + k % per_b[at]]
        combs, weights = [of_group[at].astype(np.uint64) << np.uint64(32) | pairs], [np.ones(len(at), np.int64)]
        for g in np.flatnonzero(product > DENSE).tolist():
            ua, ca = np.unique(a64[first_a[g] : first_a[g] + per_a[g]], return_counts=True)
            ub, cb = np.unique(b64[first_b[g] : first_b[g] + per_b[g]], return_counts=True)
            combs.append((np.uint64(of_group[g]) << np.uint64(32)) | (ua[:, None] | ub[None, :]).ravel())
            weights.append((ca[:, None] * cb[None, :]).ravel())
        comb, weight = merged(np.concatenate(combs), np.concatenate(weights))
        count = np.bincount((comb >> np.uint64(32)).astype(np.int64), minlength=n)
        self.begin, self.count = np.r_[self.begin, len(self.keys) + np.cumsum(count) - count], np.r_[self.count, count]
        self.keys, self.links = np.r_[self.keys, comb.astype(np.uint32)], np.r_[self.links, weight]
        self.ok, self.sums = np.r_[self.ok, ok], np.concatenate([self.sums, sums])
        if self.with_text:
            bits = np.empty(len(a) + len(b), object)
            before_b, upto_a = first_b, first_a + per_a
            for last, at, ids, (plain, closing) in ((last_a, np.arange(len(a)) + before_b[group_a], a, self.names[:2]), (last_b, np.arange(len(b)) + upto_a[group_b], b, self.names[2:])):
                bits[at[~last]], bits[at[last]] = plain[ids[~last]], closing[ids[last]]
            ends = np.cumsum(sums[:, 0] + sums[:, 1]).tolist()
            bits = bits.tolist()
            self.texts += ["".join(bits[i:j]) for i, j in zip([0, *ends], ends)]

    def held(self, texts: pa.Array, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Whether each text has tokens: not null, not empty, and both tokenizers give its bytes back."""
        bad = np.r_[0, np.cumsum(~self.ok[codes])][starts]
        size = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
        return (size > 0) & (np.diff(bad) == 0)


def pairs_of(texts: pa.Array, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Distinct id pairs of some texts, sorted, and in how many of the texts each is linked."""
    found = [np.empty(0, np.uint32)]
    for i, j in parts(texts):
        part = texts.slice(i, j - i)
        codes, starts = lexicon.look_up(part)
        own = np.repeat(lexicon.held(part, codes, starts), np.diff(starts))
        doc = np.repeat(np.arange(len(part)), np.diff(starts))[own]
        count = lexicon.count[codes[own]]
        comb = np.repeat(doc.astype(np.uint64) << np.uint64(32), count) | lexicon.keys[ragged(lexicon.begin[codes[own]], count)]
        comb.sort()
        found.append(comb[np.flatnonzero(np.r_[True, comb[1:] != comb[:-1]])].astype(np.uint32) if len(comb) else comb.astype(np.uint32))
    return np.unique(np.concatenate(found), return_counts=True)


def batches_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text, batch``: a few megabytes of neighbouring documents to a batch; written, so that batches stand."""
    size, at = F.octet_length(F.coalesce("text", F.lit(""))), F.monotonically_increasing_id()
    tier = len(BATCH_ROWS)
    batch = at * 4 + tier
    for k, (most, rows) in reversed(list(enumerate(BATCH_ROWS))):
        batch = F.when(size <= most, F.floor(at / rows).cast("long") * 4 + k).otherwise(batch)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return materialise(rows.select("doc_id", "text", batch.alias("batch")))


def _buckets(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint32(B_BITS)) % np.uint32(BUCKETS)


def batch_pairs(placed: DataFrame, ranks_path: str, pieces_path: str) -> DataFrame:
    """``batch, bucket, keys, counts`` (arrays of 32 bits, as bytes): the pairs of each batch, by bucket of A ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(ranks_path, pieces_path, False)
        for rows in batches:
            batch = rows.column(0).to_numpy(zero_copy_only=False)
            for one in np.unique(batch).tolist():
                keys, counts = pairs_of(rows.column(1).take(pa.array(np.flatnonzero(batch == one))), lexicon)
                if not len(keys):
                    continue
                bucket = _buckets(keys)
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(cuts), one)), pa.array(bucket[order][cuts].astype(np.int32)),
                        pa.array([x.tobytes() for x in np.split(keys[order], cuts[1:])], pa.binary()),
                        pa.array([x.astype(np.uint32).tobytes() for x in np.split(counts[order], cuts[1:])], pa.binary()),
                    ],
                    ["batch", "bucket", "keys", "counts"],
                )

    return placed.select("batch", "text").mapInArrow(run, "batch long, bucket int, keys binary, counts binary")


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Groups of sorted rows by their first columns, each an iterator over its rows."""
    from itertools import groupby

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(column.to_pylist() for column in batch.columns))

    return groupby(rows(), key=lambda row: row[:n_keys])


def _emit(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of a few megabytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if size > most or len(held) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, "kind")


def distinct_pairs(rows: DataFrame) -> DataFrame:
    """``bucket, keys``: the union of the keys of each (bucket, branch) of ``rows(bucket, branch, keys)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def unions() -> Iterator[tuple]:
            for (bucket, _), group in _runs(batches, 2):
                found, waiting, size = np.empty(0, np.uint32), [], 0
                for _, _, keys in group:
                    waiting.append(np.frombuffer(keys, np.uint32))
                    size += len(waiting[-1])
                    if size > max(1 << 16, len(found)):
                        found, waiting, size = np.unique(np.concatenate([found, *waiting])), [], 0
                yield bucket, np.unique(np.concatenate([found, *waiting])).tobytes()

        yield from _emit(unions(), ["bucket", "keys"], [pa.int32(), pa.binary()])

    dealt = rows.select("bucket", "branch", "keys").repartition("bucket", "branch").sortWithinPartitions("bucket", "branch")
    return dealt.mapInArrow(run, "bucket int, keys binary")


def hashed(rows: DataFrame) -> DataFrame:
    """``bucket, hash, slot_keys`` of ``rows(bucket, keys)``: the minimal perfect hash of its keys, and the keys by slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hashes() -> Iterator[tuple]:
            for (bucket,), group in _runs(batches, 1):
                keys = np.empty(0, np.uint32)
                for _, more in group:
                    keys = np.union1d(keys, np.frombuffer(more, np.uint32))
                perfect = PerfectHash.build(keys)
                by_slot = np.empty_like(keys)
                by_slot[perfect.slots(keys)] = keys
                yield bucket, perfect.to_bytes(), by_slot.tobytes()

        yield from _emit(hashes(), ["bucket", "hash", "slot_keys"], [pa.int32(), pa.binary(), pa.binary()])

    dealt = rows.select("bucket", "keys").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "bucket int, hash binary, slot_keys binary")


def verified(perfect: PerfectHash, by_slot: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slots = perfect.slots(keys)
    if (slots < 0).any() or (by_slot[slots] != keys).any():
        raise ValueError("a pair is missing from its hash: the two passes have not read the same documents")
    return slots


def branch_sums(rows: DataFrame, hashes: DataFrame, branches: int) -> DataFrame:
    """``bucket, vector``: for each branch the dense vector of the counts of its batches, by slot."""
    every = F.explode(F.sequence(F.lit(0), F.lit(branches - 1))).alias("branch")
    tables = hashes.select("bucket", every, F.lit(0).alias("kind"), F.col("hash").alias("x"), F.col("slot_keys").alias("y"))
    both = tables.union(rows.select("bucket", "branch", F.lit(1), "keys", "counts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def vectors() -> Iterator[tuple]:
            for (bucket, _), group in _runs(batches, 2):
                _, _, _, perfect, by_slot = next(group)
                perfect, by_slot = PerfectHash.from_bytes(perfect), np.frombuffer(by_slot, np.uint32)
                vector = np.zeros(len(by_slot), np.int64)
                for _, _, _, keys, counts in group:
                    vector[verified(perfect, by_slot, np.frombuffer(keys, np.uint32))] += np.frombuffer(counts, np.uint32)
                yield bucket, vector.tobytes()

        yield from _emit(vectors(), ["bucket", "vector"], [pa.int32(), pa.binary()])

    return _dealt(both, "bucket", "branch").mapInArrow(run, "bucket int, vector binary")


def bucket_sums(vectors: DataFrame, hashes: DataFrame) -> DataFrame:
    """``bucket, hash, slot_keys, counts, best``: the sum of a bucket's vectors, and which pairs have the highest count of their A id."""
    none = F.lit(None).cast("binary")
    tables = hashes.select("bucket", F.lit(0).alias("kind"), F.col("hash").alias("x"), F.col("slot_keys").alias("y"))
    both = tables.union(vectors.select("bucket", F.lit(1), "vector", none))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sums() -> Iterator[tuple]:
            for (bucket,), group in _runs(batches, 1):
                _, _, perfect, by_slot = next(group)
                a = np.frombuffer(by_slot, np.uint32) >> np.uint32(B_BITS)
                counts = np.zeros(len(a), np.int64)
                for _, _, vector, _ in group:
                    counts += np.frombuffer(vector, np.int64)
                _, back = np.unique(a, return_inverse=True)
                highest = np.zeros(int(back.max()) + 1, np.int64)
                np.maximum.at(highest, back, counts)
                yield bucket, perfect, by_slot, counts.tobytes(), (counts == highest[back]).tobytes()

        yield from _emit(sums(), ["bucket", "hash", "slot_keys", "counts", "best"], [pa.int32(), *[pa.binary()] * 4])

    return _dealt(both, "bucket").mapInArrow(run, "bucket int, hash binary, slot_keys binary, counts binary, best binary")


def answers(rows: DataFrame, tables: DataFrame, branches: int) -> DataFrame:
    """``batch, keys, counts, best``: what each batch asked for, looked up in the bucket's vectors."""
    every = F.explode(F.sequence(F.lit(0), F.lit(branches - 1))).alias("branch")
    none = F.lit(None).cast("binary")
    known = tables.select("bucket", every, F.lit(0).alias("kind"), F.lit(None).cast("long").alias("batch"), "hash", "slot_keys", "counts", "best")
    both = known.union(rows.select("bucket", "branch", F.lit(1), "batch", "keys", none, none, none))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for _, group in _runs(batches, 2):
                _, _, _, _, perfect, by_slot, counts, best = next(group)
                perfect, by_slot = PerfectHash.from_bytes(perfect), np.frombuffer(by_slot, np.uint32)
                counts, best = np.frombuffer(counts, np.int64), np.frombuffer(best, bool)
                for _, _, _, batch, keys, _, _, _ in group:
                    slots = verified(perfect, by_slot, np.frombuffer(keys, np.uint32))
                    yield batch, keys, counts[slots].tobytes(), best[slots].tobytes()

        yield from _emit(found(), ["batch", "keys", "counts", "best"], [pa.int64(), *[pa.binary()] * 3])

    return _dealt(both, "bucket", "branch").mapInArrow(run, "batch long, keys binary, counts binary, best binary")


RESULT = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


class Answers:
    """Counts of one batch's pairs."""

    def __init__(self, rows: list[tuple[bytes, bytes, bytes]]):
        keys, counts, best = (np.concatenate([np.frombuffer(r[i], t) for r in rows]) if rows else np.empty(0, t) for i, t in enumerate((np.uint32, np.int64, bool)))
        order = np.argsort(keys)
        self.keys, self.counts, self.best = keys[order], counts[order], best[order]


def aligned(texts: pa.Array, lexicon: Lexicon, known: Answers) -> tuple[np.ndarray, list[str]]:
    """(the six numbers of each text, SHA-256 of its groups)."""
    codes, starts = lexicon.look_up(texts)
    held = lexicon.held(texts, codes, starts)
    own = np.repeat(held, np.diff(starts))
    used, back = np.unique(codes[own], return_inverse=True)
    count = lexicon.count[used]
    at = ragged(lexicon.begin[used], count)
    where = np.searchsorted(known.keys, lexicon.keys[at])
    if len(at) and (where.max() >= len(known.keys) or (known.keys[where] != lexicon.keys[at]).any()):
        raise ValueError("a pair has no count: the two passes have not read the same documents")
    of = np.repeat(np.arange(len(used)), count)
    per = np.zeros((len(used), 6), np.int64)
    per[:, :4] = lexicon.sums[used]
    np.add.at(per[:, 4], of, lexicon.links[at] * known.best[where])
    np.add.at(per[:, 5], of, lexicon.links[at] * known.counts[where])
    doc = np.repeat(np.arange(len(texts)), np.diff(starts))[own]
    sums = np.zeros((len(texts), 6), np.int64)
    if len(doc):
        begin = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        sums[doc[begin]] = np.add.reduceat(per[back], begin, axis=0)
    digests, text = [""] * len(texts), lexicon.texts
    for i in np.flatnonzero(held).tolist():
        digests[i] = hashlib.sha256("".join([text[c] for c in codes[starts[i] : starts[i + 1]].tolist()])[:-1].encode()).hexdigest()
    return sums, digests


def align(docs: DataFrame, ranks_path: str, pieces_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    A are the ids of a byte-level vocabulary (a file of ranks) for a space and the text, B those of a sentencepiece vocabulary
    for the text; special tokens' strings are plain text. Null and empty texts, and those whose bytes either
    tokenizer does not give back, have no tokens: zeros and an empty digest. Groups end where tokens of both end;
    links are all pairs of tokens in a group. The count of a pair of ids is the number of documents (rows) that hold it
    linked; ``n_best`` counts links whose pair has the highest count of its A id. Repeated rows and null ids are rows of their
    own; an empty table gives an empty result; other columns are not read.
    """
    placed = batches_of(docs, id_col, text_col)
    pairs = materialise(batch_pairs(placed, ranks_path, pieces_path))
    n_batches = placed.select(F.approx_count_distinct("batch")).first()[0]
    branches = max(BRANCHES, -(-n_batches // BATCHES_A_BRANCH))
    rows = pairs.withColumn("branch", F.pmod(F.xxhash64("batch"), F.lit(branches)).cast("int"))
    hashes = materialise(hashed(distinct_pairs(rows)))
    tables = materialise(bucket_sums(branch_sums(rows, hashes, branches), hashes))
    replies = answers(rows, tables, branches)
    kind = dict(placed.dtypes)["doc_id"]
    none: list[Column] = [F.lit(None).cast("binary")] * 3
    both = replies.select("batch", F.lit(0).alias("kind"), "keys", "counts", "best", F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("string").alias("text"))
    both = both.union(placed.select("batch", F.lit(1), *none, "doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(ranks_path, pieces_path, True)
        batch, known, waiting = None, None, []
        for rows in batches:
            # Rows of a batch: its answers, then its documents.
            names = np.asarray(rows.column(0))
            kinds = np.asarray(rows.column(1))
            cuts = np.flatnonzero((names[1:] != names[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(names)]):
                if i == j:
                    continue
                if names[i] != batch:
                    batch, known, waiting = names[i], None, []
                if kinds[i] == 0:
                    waiting += zip(*(rows.column(c).slice(i, j - i).to_pylist() for c in (2, 3, 4)))
                    continue
                if known is None:
                    known, waiting = Answers(waiting), []
                texts = rows.column(6).slice(i, j - i)
                for p, q in parts(texts):
                    sums, digests = aligned(texts.slice(p, q - p), lexicon, known)
                    yield pa.RecordBatch.from_arrays([rows.column(5).slice(i + p, q - p), *(pa.array(sums[:, c]) for c in range(6)), pa.array(digests, pa.string())], ["doc_id", *RESULT, "groups_sha256"])

    dealt = both.repartition("batch").sortWithinPartitions("batch", "kind")
    return dealt.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in RESULT) + ", groups_sha256 string")
