"""Mixing sources to target weights by Pareto order sampling.

Native: DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, materialise

#: A table of sources is broadcast up to so many rows.
MAX_BROADCAST_SOURCES = 100_000
#: Documents of one source in a slice of its order; only the slice where a target ends is sorted.
SLICE_ROWS = 5_000
#: Documents of a source that a round looks at behind the first one that did not fit.
NEXT_ROWS = 1_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(id_column: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the id and the seed only: 48 bits of MD5."""
    digits = F.substring(F.md5(F.concat(F.coalesce(id_column.cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**48)


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), max_copies: int = 3) -> DataFrame:
    """Target of each source of ``sizes(source, size)``: ``source, source_size, n_docs, target``.

    Sources in code-point order, null last, take the weights in turn and share the sum of all sizes;
    none exceeds ``max_copies`` times its size, and what that frees is shared again by weight until
    none is above. In order of cap per weight the capped sources come first, so one running sum
    finds them. The windows run over the table of sources, never over documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * max_copies)
    everything = Window.partitionBy(F.lit(1))
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    per = per.withColumns({
        "total": F.sum("source_size").over(everything),
        "w_total": F.sum("weight").over(everything),
        "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "w_before": F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    level = (F.col("total") - F.col("cap_before")).cast("double") / (F.col("w_total") - F.col("w_before"))
    per = per.withColumn("capped", level * F.col("weight") > F.col("cap"))
    per = per.withColumns({
        "cap_sum": F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything),
        "w_sum": F.sum(F.when(F.col("capped"), F.col("weight")).otherwise(0)).over(everything),
    })
    level = F.try_divide((F.col("total") - F.col("cap_sum")).cast("double"), F.col("w_total") - F.col("w_sum"))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(level * F.col("weight"))
    return per.select("source", "source_size", "n_docs", target.alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (1, 2, 3),
    max_copies: int = 3,
    seed: str = "mix",
) -> DataFrame:
    """How often the mix takes each document: ``doc_id, source, size, source_size, target, copies, taken``.

    A source whose target is r times its size gives every document ``floor(r)`` certain copies. The
    words still missing are drawn by Pareto order sampling with probabilities proportional to size: a document of x words has
    inclusion probability ``n x / sum(x)``, where ``n``, the size of the sample, is chosen so that its words are expected to be those missing
    (``n sum(x^2) / sum(x)``). Documents are ranked by random odds over inclusion odds, those with probability 1 first; in that
    order each document is taken whose words still fit into the rest, others are passed over. One more document, the nearest in size
    to what is then missing, is added if that brings the source nearer. No document has more than ``max_copies`` copies.

    Random numbers depend on the id and the seed, so reruns agree. Null text has no words; such
    documents get the certain copies and count for nothing. A null source is a source. Rows that
    repeat an id, null ids too, are drawn one after the other in the order; the added one is a single row. An empty table gives an empty result.
    Other columns are not read.

    A running sum over a hot source would be one task; instead each source's order is cut into slices
    of about ``SLICE_ROWS`` documents by value, slice sums find the slice where the first document does not fit, and
    only that slice is sorted. What is missing then is less than one document; each further round looks at the next ``NEXT_ROWS`` documents
    of each source that are small enough.
    """
    sizes = materialise(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.monotonically_increasing_id().alias("__row"),
    ))
    ratio = F.try_divide(F.col("target"), F.col("source_size").cast("double"))
    squares = sizes.groupBy(F.col("source").alias("__q")).agg(F.sum(F.col("size").cast("double") * F.col("size")).alias("squares"))
    sources = source_targets(sizes, weights, max_copies)
    sources = materialise(
        sources.join(squares, F.col("source").eqNullSafe(F.col("__q"))).drop("__q")
        .withColumn("whole", F.coalesce(F.floor(ratio), F.lit(0)).cast("long"))
        .withColumn("phi", F.coalesce(ratio - F.floor(ratio), F.lit(0.0)))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("slices", F.floor(F.col("n_docs") / SLICE_ROWS) + 1)
    )
    u = F.col("__u")
    chance = F.col("size") * F.try_divide("rest", "squares")
    odds = F.when((F.col("phi") > 0) & (F.col("size") > 0), F.when(chance >= 1, 0.0).otherwise((u / (1 - u)) / (chance / (1 - chance))))
    middle = F.try_divide(1 - F.col("phi"), F.col("phi"))
    ranked = (
        sizes.withColumn("__u", uniform(F.col("doc_id"), seed))
        .join(broadcast_if_small(sources.withColumnRenamed("source", "__s"), MAX_BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("__s")))
        .withColumn("__odds", odds)
        .withColumn("__slice", F.floor(F.try_divide(F.col("__odds"), middle + F.col("__odds")) * F.col("slices")))
        .drop("__s", "__u", "squares")
    )
    sums = ranked.filter("__odds is not null").groupBy("source", "__slice").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("__slice"))
    ends = (
        sums.withColumn("upto", upto)
        .filter("upto > rest and upto - words <= rest")
        .select(F.col("source").alias("__s"), F.col("__slice").alias("__end"), (F.col("upto") - F.col("words")).alias("__before"))
    )
    ends = materialise(ends)
    placed = ranked.join(broadcast_if_small(ends, MAX_BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    order = Window.partitionBy("source").orderBy("__odds", "doc_id", "size", "__row").rowsBetween(Window.unboundedPreceding, 0)
    in_end = F.col("__slice") == F.col("__end")
    inside = placed.filter(in_end).withColumn(
        "drawn", F.col("__before") + F.sum("size").over(order) <= F.col("rest")
    )
    # Without an end all documents with odds fit.
    outside = placed.filter(~F.coalesce(in_end, F.lit(False))).withColumn(
        "drawn", F.col("__odds").isNotNull() & (F.col("__end").isNull() | (F.col("__slice") < F.col("__end")))
    )
    drawn = materialise(inside.unionByName(outside).drop("__before", "__end", "__slice"))
    more, gaps = _fitting(drawn)
    drawn = drawn.join(broadcast_if_small(more.withColumnRenamed("__row", "__more"), MAX_BROADCAST_SOURCES), F.col("__row") == F.col("__more"), "left")
    drawn = drawn.withColumn("drawn", F.col("drawn") | F.col("__more").isNotNull()).drop("__more")

    got = broadcast_if_small(gaps.select(F.col("source").alias("__s"), F.col("gap").alias("__gap")).filter("__gap > 0"), MAX_BROADCAST_SOURCES)
    best = (
        drawn.filter("phi > 0 and not drawn and size > 0")
        .join(got, F.col("source").eqNullSafe(F.col("__s")))
        .withColumn("__off", F.abs(F.col("size") - F.col("__gap")))
        .filter("__off < __gap")
        .groupBy("source")
        .agg(F.min(F.struct("__off", "__odds", "doc_id", "size", "__row")).alias("__best"))
        .select(F.col("__best.__row").alias("__best_row"))
    )
    best = broadcast_if_small(materialise(best), MAX_BROADCAST_SOURCES)
    out = drawn.join(best, F.col("__row") == F.col("__best_row"), "left")
    copies = F.col("whole") + (F.col("drawn") | F.col("__best_row").isNotNull()).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _fitting(drawn: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``__row`` of the documents behind the first that did not fit, taken in order where they fit; ``source, gap`` left over).

    A round takes, of the next documents that are no larger than the gap, those before the first that does not fit any more.
    """
    place = F.struct("__odds", "doc_id", "size", "__row")
    state = materialise(
        drawn.filter("__odds is not null").groupBy("source").agg(
            (F.first("rest") - F.sum(F.when(F.col("drawn"), F.col("size")).otherwise(0))).alias("gap"), F.min(F.when(~F.col("drawn"), place)).alias("behind"),
        )
    )
    found = drawn.select("__row").filter("false")
    while True:
        now = broadcast_if_small(state.filter("gap >= 1 and behind is not null").select(F.col("source").alias("__s"), "gap", "behind"), MAX_BROADCAST_SOURCES)
        open_ = drawn.filter("__odds is not null and not drawn").join(now, F.col("source").eqNullSafe(F.col("__s"))).filter((place > F.col("behind")) & (F.col("size") <= F.col("gap")))
        w = Window.partitionBy("source").orderBy("__odds", "doc_id", "size", "__row")
        near = open_.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= NEXT_ROWS)
        near = near.withColumn("fits", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) <= F.col("gap")).withColumn("place", place)
        near = materialise(near.select("source", "__row", "size", "place", "fits"))
        step = near.groupBy("source").agg(F.sum(F.when(F.col("fits"), F.col("size")).otherwise(0)).alias("words"), F.min(F.when(~F.col("fits"), F.col("place"))).alias("stop"), F.max("place").alias("last"))
        if not step.limit(1).count():
            return materialise(found), state
        found = found.union(near.filter("fits").select("__row"))
        after = F.when(F.col("__t").isNotNull(), F.coalesce("stop", "last")).otherwise(F.lit(None))
        joined = state.join(step.withColumn("__t", F.lit(True)).withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left")
        state = materialise(joined.select("source", (F.col("gap") - F.coalesce("words", F.lit(0))).alias("gap"), after.alias("behind")))


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mix`` takes it, with all its columns."""
    counts = mix(docs, id_col, text_col, source_col, **options)
    # The draw may treat rows with one id differently; they share its largest count here.
    counts = counts.filter("copies > 0").groupBy(F.col("doc_id").alias("__mix_id")).agg(F.max("copies").alias("__copies"))
    taken = docs.join(counts, F.col(id_col).eqNullSafe(F.col("__mix_id"))).drop("__mix_id")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).drop("__copy", "__copies")
