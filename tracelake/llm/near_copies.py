"""Near copies: SimHash anchors first, then every link of exact Jaccard similarity of word shingles.

Two texts are linked if the sets of their 5-word shingles (64-bit hashes) have a Jaccard similarity of at
least 4/5. The first candidates are the texts whose SimHash fingerprints meet at an anchor of the covering
code (``simhash.linked``). Texts as similar as 4/5 differ in some 10 of 64 bits, beyond what any such code
reaches, so the others come from prefixes: in one order of all shingles, with those that many sampled texts
hold last, sets as similar as that share a shingle among the first ``n - ceil(4n/5) + 1`` of each. Every
candidate is compared shingle by shingle, so no link is missed and none is wrong. The order decides only
the cost, so a sample is enough for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, broadcast_if_small, connected_components, discard, materialise
from .simhash import CHUNK, fingerprint_of, hash_shingles, linked

SHINGLE_WORDS = 5
#: Least similarity as a fraction.
SIMILARITY = (4, 5)
#: Texts sampled for the order of shingles, how many must hold one that is put last, and how many are kept.
SAMPLE_ROWS, COMMON_IN_SAMPLE, MAX_COMMON = 4_000, 3, 200_000
#: Ids up to this many are broadcast.
MAX_BROADCAST_SETS = 1_000_000
#: Words of the bitmap that every set has: bit ``h mod 1024`` is the parity of the shingles that fall on it.
BITMAP_WORDS = 16
#: Sets with more shingles also have a bitmap with at least 4 bits a shingle.
WIDE_FROM = 256
#: In groups up to this size the first comparison already takes all pairs.
SMALL_GROUP = 3
#: Rounds in which each row meets only its nearest row of another component, before all pairs that are left.
NEAREST_ROUNDS = 2


def set_id(grams: np.ndarray) -> int:
    """XXH64 of the whole set as a signed number."""
    return xxhash.xxh64_intdigest(grams.tobytes(), 42) - (1 << 63)


def _parities(grams: np.ndarray, bits: int) -> np.ndarray:
    return np.packbits((np.bincount(grams & (bits - 1), minlength=bits) & 1).astype(np.uint8))


def bitmap(grams: np.ndarray) -> np.ndarray:
    """Parity of the shingles on each bit; bitmaps of two sets differ in at most as many bits as the sets in shingles."""
    return _parities(grams, 64 * BITMAP_WORDS).view(np.int64)


def wide_bitmap(grams: np.ndarray) -> bytes | None:
    """The same with at least 4 bits a shingle, in a power of two of them; None for small sets."""
    if len(grams) <= WIDE_FROM:
        return None
    return _parities(grams, 1 << int(4 * len(grams) - 1).bit_length()).tobytes()


def differing_bits(a: bytes, b: bytes) -> int:
    """Bits in which two wide bitmaps differ; the larger is folded by XOR of its halves to the size of the smaller."""
    x, y = (np.frombuffer(v, np.uint8) for v in (a, b))
    while len(x) != len(y):
        if len(x) > len(y):
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        else:
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def prefix_length(n: int, similarity: tuple[int, int] = SIMILARITY) -> int:
    num, den = similarity
    return n - -(-num * n // den) + 1 if n else 0


def common_shingles(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of a bounded sample of texts hold, sorted, and how many hold them.

    The sample is drawn from the ids; only the texts it names are read further.
    """
    ids = bounded_sample(docs.select(F.col(id_col).alias("doc_id")), "doc_id", SAMPLE_ROWS)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("binary").alias("text"))
    sample = rows.join(F.broadcast(ids), F.col("__id").eqNullSafe(F.col("doc_id")), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(hash_shingles(text.as_py() or b"", shingle)).view(np.int64))], ["gram"])

    counts = sample.distinct().mapInArrow(run, "gram long").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    top = counts.filter(F.col("n") >= COMMON_IN_SAMPLE).orderBy(F.desc("n"), "gram").limit(MAX_COMMON).collect()
    found = sorted((r["gram"], r["n"]) for r in top)
    return np.array([g for g, _ in found], np.int64), np.array([n for _, n in found], np.int64)


def signatures(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], id_col: str, text_col: str, shingle: int, similarity: tuple[int, int]) -> DataFrame:
    """``doc_id, sid, n, fp, bits, wide, prefix`` of every row, hashed in one pass over the texts.

    ``sid`` names the set of shingles and ``n`` is its size, ``fp`` the SimHash fingerprint, ``bits`` and
    ``wide`` are bitmaps, ``prefix`` the first shingles in the common order.
    """
    names, counts = common
    rows = docs.select(F.col(text_col).cast("binary").alias("text"), F.col(id_col).alias("doc_id"))

    def prefix(grams: np.ndarray) -> np.ndarray:
        if len(names):
            at = np.minimum(np.searchsorted(names, grams), len(names) - 1)
            grams = grams[np.argsort(np.where(names[at] == grams, counts[at], 0), kind="stable")]
        return grams[: prefix_length(len(grams), similarity)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                out: list[list] = [[] for _ in range(6)]
                for text in part.column(0):
                    hashes = hash_shingles(text.as_py() or b"", shingle)
                    grams = np.unique(hashes).view(np.int64)
                    for column, value in zip(out, (set_id(grams), len(grams), fingerprint_of(hashes), bitmap(grams), wide_bitmap(grams), prefix(grams))):
                        column.append(value)
                fps = np.array(out[2], np.uint64).view(np.int64)
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(fps), pa.array(out[3], longs), pa.array(out[4], pa.binary()), pa.array(out[5], longs)],
                    ["doc_id", "sid", "n", "fp", "bits", "wide", "prefix"],
                )

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, sid long, n int, fp long, bits array<long>, wide binary, prefix array<long>")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows, sorted by gram, whose gram another row has too. Only the last row of a batch waits for the next."""
    held: list[np.ndarray] | None = None
    last_known = False
    for batch in batches:
        if not batch.num_rows:
            continue
        got = [batch.column(i).to_numpy() for i in range(4)]
        rows = got if held is None else [np.r_[h, g] for h, g in zip(held, got)]
        same = rows[0][1:] == rows[0][:-1]
        again = np.r_[last_known, same] | np.r_[same, False]
        yield pa.RecordBatch.from_arrays([pa.array(x[:-1][again[:-1]]) for x in rows], batch.schema.names)
        held, last_known = [x[-1:] for x in rows], bool(again[-1])
    if held is not None and last_known:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["gram", "sid", "n", "pos"])


#: Rows of one gram in a tile, about.
TILE = 20_000


def _plain(column: pa.Array) -> np.ndarray:
    """Numbers of a column; lists of one length as rows of a matrix."""
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy().reshape(len(column), -1)
    return column.to_numpy(zero_copy_only=False)


def _by_group(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """Columns of whole groups of the first name, from rows that come sorted by it."""
    waiting: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        got = [_plain(batch.column(batch.schema.get_field_index(x))) for x in names]
        if waiting and got[0][-1] == waiting[0][0][-1]:
            waiting.append(got)
            continue
        cut = int(np.searchsorted(got[0], got[0][-1]))
        yield [np.concatenate(x) for x in zip(*waiting, [g[:cut] for g in got])]
        waiting = [[g[cut:] for g in got]]
    if waiting:
        yield [np.concatenate(x) for x in zip(*waiting)]


def _may_link(n: np.ndarray, pos: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """Whether rows ``a`` and ``b`` of a group can be similar, if the group's shingle is the first they share."""
    num, den = similarity
    most = np.minimum(n[a] - pos[a], n[b] - pos[b]).astype(np.int64)
    return (num + den) * most >= num * (n[a].astype(np.int64) + n[b])


def _batch(a: np.ndarray, b: np.ndarray, sid: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.minimum(sid[a], sid[b]), np.maximum(sid[a], sid[b])]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])


def _chained(similarity: tuple[int, int]):
    """Candidate pairs ``a, b`` of rows sorted by gram: each with the one before it and with the first of its gram.

    Two rows are held from one batch to the next, however many share a gram.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            got = [_plain(batch.column(i)) for i in range(4)]
            rows = got if held is None or held[0][-1] != got[0][0] else [np.r_[h, g] for h, g in zip(held, got)]
            gram, sid, n, pos = rows
            starts = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
            first = np.repeat(starts, np.diff(np.r_[starts, len(gram)]))
            row = np.arange(len(gram))
            inner = row[row > first]
            a, b = np.r_[first[inner], inner - 1], np.r_[inner, inner]
            ok = _may_link(n, pos, a, b, similarity) & (sid[a] != sid[b])
            yield _batch(a[ok], b[ok], sid)
            held = [x[[first[-1], len(gram) - 1]] for x in rows]

    return run


class _Nearest:
    """For each of some rows the partner at the least distance seen so far."""

    def __init__(self, rows: int):
        self.least, self.mate = np.full(rows, np.inf), np.full(rows, -1)

    def add(self, a: np.ndarray, b: np.ndarray, distance: np.ndarray) -> None:
        for x, y in ((a, b), (b, a)):
            order = np.lexsort((distance, x))
            order = order[np.r_[True, x[order][1:] != x[order][:-1]]] if len(order) else order
            order = order[distance[order] < self.least[x[order]]]
            self.least[x[order]], self.mate[x[order]] = distance[order], y[order]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        row = np.flatnonzero(self.mate >= 0)
        return row, self.mate[row]


def _compared(similarity: tuple[int, int], nearest: bool = False):
    """Candidate pairs ``a, b`` of different roots in each group of tiles, as far as the bitmaps allow them.

    A group is one tile with itself or two tiles with each other, so it is bounded. With ``nearest`` each row gives one pair at
    most, with the row whose bitmap differs least for their sizes.
    """
    num, den = similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gram, root, sid, n, pos, tile, apart, bits in _by_group(batches, ("gram", "root", "sid", "n", "pos", "tile", "apart", "bits")):
            if not len(gram):
                continue
            # Each row with all of later roots in its group, a bounded number of pairs at a time.
            starts = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
            sizes = np.diff(np.r_[starts, len(gram)])
            runs = np.flatnonzero(np.r_[True, (gram[1:] != gram[:-1]) | (root[1:] != root[:-1])])
            run_end = np.repeat(np.r_[runs[1:], len(gram)], np.diff(np.r_[runs, len(gram)]))
            later = np.repeat(starts + sizes, sizes) - run_end
            ends, at = np.cumsum(later), 0
            best = _Nearest(len(gram)) if nearest else None
            while at < len(gram):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK // BITMAP_WORDS)))
                per = later[at:to]
                a = np.repeat(np.arange(at, to), per)
                b = np.repeat(run_end[at:to], per) + np.arange(len(a)) - np.repeat(np.cumsum(per) - per, per)
                ok = _may_link(n, pos, a, b, similarity) & (~apart[a] | (tile[a] != tile[b]))
                a, b = a[ok], b[ok]
                differ, size = np.bitwise_count(bits[a] ^ bits[b]).sum(1, dtype=np.int64), n[a].astype(np.int64) + n[b]
                ok = differ * (num + den) <= size * (den - num)
                if best is None:
                    yield _batch(a[ok], b[ok], sid)
                else:
                    best.add(a[ok], b[ok], differ[ok] / size[ok])
                at = to
            if best is not None:
                yield _batch(*best.pairs(), sid)

    return run


def tiled(rooted: DataFrame, tile: int | None = None) -> DataFrame:
    """Rows ``gram, root, sid, n, pos`` of large grams with more than one root, dealt to groups of bounded size.

    A gram that more than ``tile`` rows hold is cut by a hash into tiles, and each pair of tiles is a group; ``gram`` then names the group,
    ``tile`` the row's own tile, and ``apart`` says that only rows of different tiles are to be compared.
    """
    tile = tile or TILE
    stats = rooted.groupBy("gram").agg(F.count(F.lit(1)).alias("__n"), F.min("root").alias("__low"), F.max("root").alias("__high"))
    stats = materialise(stats.filter((F.col("__n") > SMALL_GROUP) & (F.col("__low") < F.col("__high"))).select("gram", F.ceil(F.col("__n") / tile).cast("int").alias("tiles")))
    rows = rooted.join(broadcast_if_small(stats, MAX_BROADCAST_SETS), "gram")
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("sid"), F.col("tiles")).cast("int")).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    group = F.xxhash64("gram", F.least("tile", "__other"), F.greatest("tile", "__other"))
    return rows.select(group.alias("gram"), "root", "sid", "n", "pos", "tile", (F.col("tile") != F.col("__other")).alias("apart"))


def anchor_pairs(distinct: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of set ids of ``distinct(sid, fp)`` whose fingerprints are linked over anchors, or are equal."""
    prints = materialise(distinct.groupBy("fp").agg(F.min("sid").alias("first")))
    met = linked(prints.select("fp"))
    of = [prints.select(F.col("fp").alias(f), F.col("first").alias(s)) for f, s in (("a", "x"), ("b", "y"))]
    apart = met.join(of[0], "a").join(of[1], "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    equal = distinct.join(prints, "fp").filter("sid <> first").select(F.col("first").alias("a"), F.col("sid").alias("b"))
    return apart.union(equal).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _near_by_wide_bitmaps(similarity: tuple[int, int]):
    num, den = similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, n in zip(batch.column(2), batch.column(3), batch.column(4).to_pylist()):
                x, y = x.as_py(), y.as_py()
                keep.append(x is None or y is None or differing_bits(x, y) * (num + den) <= n * (den - num))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def confirmed(pairs: DataFrame, docs: DataFrame, distinct: DataFrame, shingle: int, similarity: tuple[int, int]) -> DataFrame:
    """The pairs ``a, b`` whose sets reach the similarity, compared shingle by shingle; written out.

    Before whole sets are made again from their texts, two bitmaps rule out the pairs that surely differ too
    much: a short one for all, then one in proportion to the set. ``docs`` has ``doc_id, text``.
    """
    num, den = similarity
    short = [distinct.select(F.col("sid").alias(k), F.col("n").cast("long").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}")) for k in "ab"]
    both = pairs.distinct().join(short[0], "a").join(short[1], "b")
    differ = sum((F.bit_count(F.get("bits_a", F.lit(i)).bitwiseXOR(F.get("bits_b", F.lit(i)))) for i in range(BITMAP_WORDS)), F.lit(0))
    left = materialise(both.filter(differ * (num + den) <= (F.col("n_a") + F.col("n_b")) * (den - num)).select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n")))
    wide = [distinct.select(F.col("sid").alias(k), F.col("wide").alias(f"wide_{k}")) for k in "ab"]
    both = left.join(wide[0], "a").join(wide[1], "b").select("a", "b", "wide_a", "wide_b", "n")
    near = materialise(both.mapInArrow(_near_by_wide_bitmaps(similarity), "a long, b long"))
    wanted = near.select("a").union(near.select("b")).toDF("sid").distinct()
    wanted = materialise(wanted.join(distinct.select("sid", "least"), "sid"))
    sets = materialise(_sets_of(docs, wanted, shingle))
    x, y = (sets.select(F.col("sid").alias(k), F.col("grams").alias(name)) for k, name in (("a", "x"), ("b", "y")))
    same = F.size(F.array_intersect("x", "y")).cast("long")
    total = F.size("x").cast("long") + F.size("y")
    out = materialise(near.join(x, "a").join(y, "b").filter(same * (num + den) >= total * num).select("a", "b"))
    discard(left, near, wanted, sets)
    return out


def _sets_of(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``sid, grams`` of the sets in ``wanted(sid, least)``, from the texts with those least ids only."""
    ids = broadcast_if_small(wanted.select("least").distinct(), MAX_BROADCAST_SETS)
    texts = docs.join(ids, docs["doc_id"].eqNullSafe(F.col("least")), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                grams = np.unique(hash_shingles(text.as_py() or b"", shingle)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([set_id(grams)]), pa.array([grams], pa.list_(pa.int64()))], ["sid", "grams"])

    # Rows with one id but other texts give sets that nobody wants, or sets twice.
    sets = texts.mapInArrow(run, "sid long, grams array<long>")
    return sets.join(broadcast_if_small(wanted.select("sid"), MAX_BROADCAST_SETS), "sid", "left_semi").dropDuplicates(["sid"])


def links(docs: DataFrame, distinct: DataFrame, shingle: int = SHINGLE_WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Links ``(a, b)`` between set ids that connect all sets as similar as that.

    First come the pairs that meet at SimHash anchors, and each prefix group's sets with the group's first and
    their neighbours; what that joins need not be compared again, so that large families of copies cost
    little. Then, in groups whose sets are not all in one component, each set with its nearest of another component,
    so that a family in pieces grows together over as many pairs as it has sets. Last come all other pairs between components.
    """
    grams = distinct.filter("n > 0").select("sid", "n", F.posexplode("prefix").alias("pos", "gram")).select("gram", "sid", "n", "pos")
    shared = materialise(grams.repartition("gram").sortWithinPartitions("gram").mapInArrow(_shared, "gram long, sid long, n int, pos int"))
    first = shared.repartition("gram").sortWithinPartitions("gram", "sid").mapInArrow(_chained(similarity), "a long, b long")
    met = anchor_pairs(distinct.filter("n > 0").select("sid", "fp"))
    found = confirmed(met.union(first), docs, distinct, shingle, similarity)
    for nearest in (*[True] * NEAREST_ROUNDS, False):
        roots = materialise(connected_components(found).withColumnRenamed("node", "sid"))
        rooted = shared.join(broadcast_if_small(roots, MAX_BROADCAST_SETS), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        signed = tiled(rooted).join(distinct.select("sid", "bits"), "sid")
        rest = signed.repartition("gram").sortWithinPartitions("gram", "root", "sid").mapInArrow(_compared(similarity, nearest), "a long, b long")
        found = found.union(confirmed(rest, docs, distinct, shingle, similarity))
        discard(roots)
    discard(shared)
    return found


def near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE_WORDS,
    similarity: tuple[int, int] = SIMILARITY,
) -> DataFrame:
    """One row per input row: ``doc_id, component_id``, the smallest id reachable over links.

    Texts with equal sets are one group without comparison; a text shorter than a shingle is a shingle of
    its own, and texts without words (null, empty, blank) are equal. Null ids take part; a group of null ids
    only has a null component. An empty table gives an empty result. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    signed = materialise(signatures(docs, common_shingles(docs, id_col, text_col, shingle), id_col, text_col, shingle, similarity))
    of = materialise(signed.select("doc_id", "sid"))
    distinct = materialise(signed.groupBy("sid").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("n", "fp", "bits", "wide", "prefix"))))
    discard(signed)
    roots = connected_components(links(rows, distinct, shingle, similarity))
    roots = materialise(distinct.select("sid", "least").join(roots.withColumnRenamed("node", "sid"), "sid").select("sid", "root", "least"))
    least = roots.groupBy("root").agg(F.min("least").alias("least_of_all"))
    found = roots.join(least, "root").select("sid", "least_of_all")
    named = materialise(distinct.select("sid", "least").join(found, "sid", "left").select("sid", F.coalesce("least_of_all", "least").alias("component_id")))
    discard(distinct, roots)
    return of.join(named, "sid").select("doc_id", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that have the smallest id of their group of near copies, with all columns.

    Few documents go, so the ids that go are taken out; texts are shuffled only if these are too many to broadcast.
    """
    groups = near_copies(docs, id_col, text_col, **options)
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = groups.groupBy(F.col("doc_id").alias("__gone_id")).agg(F.max(stays).alias("__stays")).filter("not __stays").select("__gone_id")
    gone = broadcast_if_small(materialise(gone), MAX_BROADCAST_SETS)
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col("__gone_id")), "left_anti")
