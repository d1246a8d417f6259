"""Hard-negative mining over an inverted multi-index.

Vectors are split in half. Two codebooks of half-space centres, fitted on a bounded sample, form cells; every row lies in
one cell, and large cells are cut into blocks. For an anchor a half-score bound of each centre is its inner product with
the anchor's half plus the half's length times the centre's radius over all rows. A heap visits cells by the sum of two
such bounds, best first (the multi-sequence order), so after any cell no later row scores above the next cell's bound.
An anchor asks for cells in rounds of growing size; it is done once what it has found is certified against that bound:
its positives first, then the first rows of each score window. A row of the result is thus exact, whatever the codebooks.

Requests and blocks meet in Spark, by block and tile of anchors; codebooks and the directory of cells (at most
``MAX_CENTRES`` squared entries) are all that tasks hold beside one block and one tile.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_sample, broadcast_if_small, discard, materialise

#: Rows that the codebooks are fitted on, at most, and rounds of k-means.
SAMPLE_ROWS, FIT_ROUNDS = 20_000, 8
#: Rows that a cell should have; the number of centres of a half follows from it, within bounds.
CELL_ROWS, MAX_CENTRES = 256, 256
#: Rows of a block and anchors of a tile, about.
BLOCK_ROWS, TILE_ANCHORS = 4096, 4096
#: Rows an anchor asks for in its first round; each later round asks for so many times more.
FIRST_ROWS, GROWTH = 8192, 4
POSITIVES, NEGATIVES = 5, 10
#: Scaled components below this bound have exact inner products in 64 bits.
COMPONENT_BOUND = 1 << 27


def scaled(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """``vec_id, label, q, copies``: rows that take part, components as ``floor(scale * x)``, equal rows counted in one.

    Rows with a null label, a null vector or a component that is null, not finite or not below ``COMPONENT_BOUND`` once
    scaled are left out.
    """
    x = F.transform(F.col(vector_col), lambda v: F.floor(F.when(F.abs(v.cast("double") * scale) < COMPONENT_BOUND, v.cast("double") * scale)))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), x.alias("q"))
    whole = rows.filter("label is not null and q is not null and not exists(q, v -> v is null)")
    return whole.groupBy("vec_id", "label", "q").agg(F.count(F.lit(1)).alias("copies"))


def padded(lists: list, width: int) -> np.ndarray:
    """Vectors as rows of a matrix; shorter ones end in zeros."""
    out = np.zeros((len(lists), width))
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def matrix(column: pa.Array, width: int) -> np.ndarray:
    values, ends = np.asarray(column.flatten(), float), np.asarray(column.offsets, np.int64)
    if (np.diff(ends) == width).all():
        return values.reshape(-1, width)
    return padded([values[a - ends[0] : b - ends[0]] for a, b in zip(ends, ends[1:])], width)


def fit(sample: np.ndarray, centres: int, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Centres of one half-space by k-means, from evenly spaced rows of the sample."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    found = sample[np.unique(np.linspace(0, len(sample) - 1, centres).astype(int))].copy()
    for _ in range(rounds):
        own = assign(sample, found)
        sums = np.zeros_like(found)
        np.add.at(sums, own, sample)
        n = np.bincount(own, minlength=len(found))
        found[n > 0] = sums[n > 0] / n[n > 0, None]
    return found


def assign(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1)[None, :] - 2 * rows @ centres.T, 1)


class Index:
    """Codebooks, radii and the directory of cells with their number of rows and blocks."""

    def __init__(self, books: tuple[np.ndarray, np.ndarray], radii: tuple[np.ndarray, np.ndarray], sizes: np.ndarray, block_rows: int):
        self.books, self.radii, self.sizes = books, radii, sizes
        self.half = books[0].shape[1]
        self.blocks = -(-sizes // block_rows)
        self.first_block = np.cumsum(self.blocks).reshape(sizes.shape) - self.blocks

    def halves(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return q[..., : self.half], q[..., self.half :]

    def bounds(self, anchor: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half: upper bounds of the half-scores of each centre's rows, and lower ones."""
        out = []
        for part, book, radius in zip(self.halves(anchor), self.books, self.radii):
            middle, reach = book @ part, np.linalg.norm(part) * radius
            slack = 1e-9 * (np.abs(middle) + reach) + 1e-3
            out.append((middle + reach + slack, middle - reach - slack))
        return out

    def visit(self, anchor: np.ndarray) -> Iterator[tuple[float, float, int, int]]:
        """(upper bound, lower bound, centre of the first half, of the second) of all cells, by falling upper bound.

        The multi-sequence heap: both halves' centres are sorted by bound; a cell enters the heap once its
        neighbours before it on both axes have left.
        """
        (up1, low1), (up2, low2) = self.bounds(anchor)
        one, two = np.argsort(-up1, kind="stable").tolist(), np.argsort(-up2, kind="stable").tolist()
        up1, up2, low1, low2 = up1.tolist(), up2.tolist(), low1.tolist(), low2.tolist()
        heap, left = [(-(up1[one[0]] + up2[two[0]]), 0, 0)], [0] * len(one)
        while heap:
            bound, i, j = heapq.heappop(heap)
            left[i] = j + 1
            yield -bound, low1[one[i]] + low2[two[j]], one[i], two[j]
            if i + 1 < len(one) and left[i + 1] == j:
                heapq.heappush(heap, (-(up1[one[i + 1]] + up2[two[j]]), i + 1, j))
            if j + 1 < len(two) and (i == 0 or left[i - 1] > j + 1):
                heapq.heappush(heap, (-(up1[one[i]] + up2[two[j + 1]]), i, j + 1))


def build(rows: DataFrame, block_rows: int = BLOCK_ROWS, cell_rows: int = CELL_ROWS) -> tuple[DataFrame, Index]:
    """(``rid, vec_id, label, q, copies, block`` of all rows, written; the index) of rows made by ``scaled``."""
    named = materialise(rows.withColumn("rid", F.monotonically_increasing_id()))
    n, width = named.agg(F.count(F.lit(1)), F.max(F.size("q"))).first()
    width = max(2, width or 0)
    half = width // 2
    sample = [r["q"] for r in bounded_sample(named.select("rid", "q"), "rid", SAMPLE_ROWS).orderBy("rid").collect()]
    sample = padded(sample, width)
    centres = int(min(MAX_CENTRES, max(1, round((n / cell_rows) ** 0.5))))
    books = fit(sample[:, :half], centres), fit(sample[:, half:], centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = matrix(batch.column(3), width)
            cells, reach = [], []
            for part, book in ((q[:, :half], books[0]), (q[:, half:], books[1])):
                cells.append(assign(part, book))
                reach.append(np.linalg.norm(part - book[cells[-1]], axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c.astype(np.int32)) for c in cells), *(pa.array(r) for r in reach)], [*batch.schema.names, "c1", "c2", "r1", "r2"])

    placed = materialise(named.select("rid", "vec_id", "label", "q", "copies").mapInArrow(place, "rid long, vec_id long, label long, q array<long>, copies long, c1 int, c2 int, r1 double, r2 double"))
    discard(named)
    sizes = np.zeros((len(books[0]), len(books[1])), np.int64)
    radii = np.zeros(len(books[0])), np.zeros(len(books[1]))
    # One row a cell, so at most the square of MAX_CENTRES.
    for c1, c2, count, r1, r2 in placed.groupBy("c1", "c2").agg(F.count(F.lit(1)), F.max("r1"), F.max("r2")).collect():
        sizes[c1, c2] = count
        radii[0][c1], radii[1][c2] = max(radii[0][c1], r1), max(radii[1][c2], r2)
    index = Index(books, radii, sizes, block_rows)
    cells = [(i, j, int(index.first_block[i, j]), int(index.blocks[i, j])) for i, j in np.argwhere(sizes).tolist()]
    directory = rows.sparkSession.createDataFrame(cells, "c1 int, c2 int, first long, blocks long")
    block = F.col("first") + F.pmod(F.xxhash64("rid"), F.col("blocks"))
    return placed.join(broadcast_if_small(directory, MAX_CENTRES**2), ["c1", "c2"]).select("rid", "vec_id", "label", "q", "copies", block.alias("block")), index


def plan(anchors: DataFrame, index: Index, first_rows: int, growth: int) -> DataFrame:
    """``aid, upto, bound, blocks``: the blocks each open anchor asks for next, and the bound on all it has not asked for then.

    ``anchors`` has ``aid, q, visited`` (rows asked for so far), ``upto`` (cells left behind), and ``low, high``: scores that
    matter. Cells that lie above or below them as a whole are passed over; null ``bound`` says that no cell is left.
    """
    width = index.books[0].shape[1] + index.books[1].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, blocks, first = index.sizes, index.blocks, index.first_block
        for batch in batches:
            out = []
            q = matrix(batch.column(1), width)
            for aid, anchor, visited, upto, low, high in zip(batch.column(0).to_pylist(), q, *(batch.column(c).to_pylist() for c in range(2, 6))):
                budget, wanted, at, bound = max(first_rows, (growth - 1) * visited), [], 0, None
                taken = 0
                for upper, lower, i, j in index.visit(anchor):
                    at += 1
                    if at <= upto or not sizes[i, j]:
                        continue
                    if taken >= budget or (low is not None and upper < low):
                        at, bound = at - 1, upper
                        break
                    if high is None or lower <= high:
                        wanted += range(int(first[i, j]), int(first[i, j] + blocks[i, j]))
                        taken += int(sizes[i, j])
                out.append((aid, at, bound, visited + taken, wanted))
            columns = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.int64())))], ["aid", "upto", "bound", "visited", "blocks"])

    return anchors.select("aid", "q", "visited", "upto", "low", "high").mapInArrow(run, "aid long, upto long, bound double, visited long, blocks array<long>")


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where they hold all sums, else in 64 bits."""
    if not len(a) or not len(b) or np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2.0**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def best_of(scores: np.ndarray, keep: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores where ``keep``; rows are sorted by id, so the first of equals is the smaller."""
    at = np.flatnonzero(keep)
    if len(at) > k:
        least = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= least]
    return at[np.argsort(-scores[at], kind="stable")][:k]


class Best:
    """The first rows of each (anchor, place) among those of all blocks that a task compares, so that few leave it."""

    def __init__(self, most: int = 50_000):
        self.most, self.rows, self.kept = most, [], 0

    def add(self, rows: list[tuple]) -> None:
        self.rows += rows
        if len(self.rows) > self.kept + self.most:
            self.prune()

    def prune(self) -> None:
        # Null ids come last among equal scores; the place tells positives from negatives.
        self.rows.sort(key=lambda r: (r[0], r[1], -r[3], r[2] is None, r[2] or 0))
        out, now, n = [], None, 0
        for r in self.rows:
            if r[:2] != now:
                now, n = r[:2], 0
            if n < (NEGATIVES if r[1] else POSITIVES):
                out.append(r)
                n += 1
        self.rows, self.kept = out, len(out)

    def full(self) -> bool:
        return self.kept > 8 * self.most

    def take(self) -> pa.RecordBatch:
        self.prune()
        rows, self.rows, self.kept = self.rows, [], 0
        columns = zip(*rows) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["aid", "place", "vec_id", "score", "copies"])


def compare(requests: DataFrame, rows: DataFrame, width: int, tile_anchors: int, n_anchors: int) -> DataFrame:
    """``aid, place, vec_id, score, copies``: of each block, what an anchor may want of it.

    ``requests`` has ``aid, q, label, windows, blocks``. Without windows: the first ``POSITIVES`` other rows of the anchor's
    label (place 0); with them: for each window ``place, low, high`` the first ``NEGATIVES`` rows of other labels in it.
    """
    tiles = -(-n_anchors // tile_anchors)
    asked = requests.select("aid", "q", "label", "windows", F.explode("blocks").alias("block")).withColumn("tile", F.pmod(F.xxhash64("aid"), F.lit(tiles)).cast("int"))
    needed = asked.select("block", "tile").distinct()
    windows = "array<struct<place:int,low:bigint,high:bigint>>"
    none = F.lit(None)
    left = asked.select("block", "tile", F.lit(1).alias("kind"), F.col("aid").alias("id"), "label", "q", none.cast("long").alias("vec_id"), none.cast("long").alias("copies"), "windows")
    right = rows.join(needed, "block").select("block", "tile", F.lit(0), F.col("rid"), "label", "q", "vec_id", "copies", none.cast(windows))
    dealt = left.union(right).repartition("block", "tile").sortWithinPartitions("block", "tile", "kind", F.col("vec_id").asc_nulls_last())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[pa.RecordBatch] = []
        now, held = None, None
        best = Best()
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c), np.int64) for c in range(3)], 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                if i == j:
                    continue
                part = batch.slice(i, j - i)
                if tuple(keys[i, :2]) != now:
                    now, block, held = tuple(keys[i, :2]), [], None
                if keys[i, 2] == 0:
                    block.append(part)
                    continue
                if held is None:
                    table = pa.Table.from_batches(block, batch.schema).combine_chunks() if block else None
                    held = table and (matrix(table["q"].combine_chunks(), width), *(table[c].to_numpy() for c in ("id", "label", "copies")), table["vec_id"].to_pylist())
                if held:
                    best.add(answer(part, *held))
                    if best.full():
                        yield best.take()
        yield best.take()

    def answer(part, q, ids, labels, copies, names) -> list[tuple]:
        out = []
        for at in range(0, part.num_rows, 512):
            some = part.slice(at, 512)
            scores = inner_products(matrix(some.column(5), width), q)
            for row, aid, label, windows in zip(scores, some.column(3).to_pylist(), some.column(4).to_pylist(), some.column(8).to_pylist()):
                if windows is None:
                    count = np.where(ids == aid, copies - 1, copies)
                    out += [(aid, 0, names[k], int(row[k]), int(count[k])) for k in best_of(row, (labels == label) & (count > 0), POSITIVES)]
                    continue
                other = labels != label
                for w in windows:
                    out += [(aid, w["place"], names[k], int(row[k]), int(copies[k])) for k in best_of(row, other & (row >= w["low"]) & (row <= w["high"]), NEGATIVES)]
        return out

    return dealt.mapInArrow(run, "aid long, place int, vec_id long, score long, copies long")


def first_rows_of(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each (anchor, place), by falling score, then id; equal rows count one by one. ``rank`` from 1."""
    w = Window.partitionBy("aid", "place").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    each = found.withColumn("copies", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k))))).withColumn("copies", F.lit(1).cast("long"))
    return each.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _search(anchors: DataFrame, rows: DataFrame, index: Index, k: int, options: dict) -> DataFrame:
    """Rounds of requests until the first ``k`` rows of every anchor and place are certified.

    ``anchors``: ``aid, q, label, windows, places, visited``. An anchor is done when no cell is left, or each of its places has ``k`` rows
    whose last scores above the bound, or whose window lies above it.
    """
    width = index.books[0].shape[1] + index.books[1].shape[1]
    spark = anchors.sparkSession
    low = F.array_min(F.transform("windows", lambda w: w["low"])).cast("double")
    high = F.array_max(F.transform("windows", lambda w: w["high"])).cast("double")
    open_ = materialise(anchors.select("aid", "visited", F.lit(0).cast("long").alias("upto")))
    found = spark.createDataFrame([], "aid long, place int, vec_id long, score long, copies long, rank int")
    n_open = open_.count()
    lent: list[DataFrame] = []
    while n_open:
        now = open_.join(anchors.drop("visited"), "aid").withColumn("low", low).withColumn("high", high)
        asked = materialise(plan(now, index, options["first_rows"], options["growth"]))
        more = compare(asked.join(anchors.select("aid", "q", "label", "windows"), "aid"), rows, width, options["tile_anchors"], n_open)
        found = materialise(first_rows_of(found.drop("rank").union(more), k))
        # Places that a bound may still change: fewer than k rows, or the last of them not above it.
        last = found.groupBy("aid", "place").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
        places = anchors.select("aid", F.explode(F.coalesce("windows", F.array(F.struct(F.lit(0).alias("place"), F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high"))))).alias("w")).select("aid", "w.place", "w.low")
        left = asked.filter("bound is not null").join(places, "aid").join(last, ["aid", "place"], "left")
        unsure = (F.coalesce("n", F.lit(0)) < k) | (F.col("least") <= F.col("bound"))
        unsure = unsure & (F.col("low").isNull() | (F.col("low") <= F.col("bound")))
        again = left.filter(unsure).groupBy("aid").agg(F.max("visited").alias("visited"), F.max("upto").alias("upto"))
        lent += [open_, asked, found]
        open_ = materialise(again)
        n_open = open_.count()
    discard(open_, *[t for t in lent if t is not found])
    return found


def mine(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    anchor_every: int = 100,
    relabel_every: int | None = 7,
    low_percent: int = 30,
    high_percent: int = 90,
    block_rows: int = BLOCK_ROWS,
    cell_rows: int = CELL_ROWS,
    first_rows: int = FIRST_ROWS,
    growth: int = GROWTH,
    tile_anchors: int = TILE_ANCHORS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for each anchor and positive.

    Anchors are rows whose id is divisible by ``anchor_every``; scores are integer inner products. Positives are an anchor's
    first ``POSITIVES`` other rows of its label, negatives the first ``NEGATIVES`` rows of other labels whose score lies between the two
    percentages of the positive's; higher scores come first, then smaller ids, null ids last. A positive with a
    negative score has an empty window. Where an id is divisible by ``relabel_every`` the label becomes the next of ten. Repeated
    rows are rows of their own, as anchors too. Vectors of unequal lengths end in zeros. Rows without a label or
    with an unusable vector take no part; an empty table gives an empty result; other columns are not read.
    """
    rows = scaled(vectors, id_col, vector_col, label_col)
    if relabel_every:
        rows = rows.withColumn("label", F.when(F.col("vec_id") % relabel_every == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
        rows = rows.groupBy("vec_id", "label", "q").agg(F.sum("copies").alias("copies"))
    rows, index = build(rows, block_rows, cell_rows)
    options = {"first_rows": first_rows, "growth": growth, "tile_anchors": tile_anchors}
    windows = "array<struct<place:int,low:bigint,high:bigint>>"
    anchors = materialise(rows.filter(F.col("vec_id") % anchor_every == 0).select(F.col("rid").alias("aid"), "vec_id", "label", "q", "copies"))
    positives = _search(anchors.select("aid", "q", "label", F.lit(None).cast(windows).alias("windows"), F.lit(0).cast("long").alias("visited")), rows, index, POSITIVES, options)
    score = F.col("score").cast("decimal(22,0)")
    window = F.struct(F.col("rank").alias("place"), F.ceil(score * low_percent / 100).cast("long").alias("low"), F.floor(score * high_percent / 100).cast("long").alias("high"))
    wanted = positives.select("aid", window.alias("w")).filter("w.low <= w.high").groupBy("aid").agg(F.collect_list("w").cast(windows).alias("windows"))
    second = anchors.join(wanted, "aid").select("aid", "q", "label", "windows", F.lit(0).cast("long").alias("visited"))
    negatives = _search(materialise(second), rows, index, NEGATIVES, options)
    pairs = negatives.select("aid", F.col("place"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = pairs.join(positives.select("aid", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), ["aid", "place"])
    out = out.join(anchors.select("aid", F.col("vec_id").alias("anchor_id"), F.sequence(F.lit(1), F.col("copies")).alias("each")), "aid").withColumn("each", F.explode("each"))
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
