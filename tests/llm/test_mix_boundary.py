"""A draw that ends exactly between two slices of a source's order."""

from tracelake.llm import mixing


def test_draw_ends_on_a_slice_boundary(spark):
    a = spark.range(5926, 14926).selectExpr("id as doc_id", "'w' as text", "'a' as source")
    b = spark.range(1, 4501).selectExpr("id as doc_id", "'w' as text", "'b' as source")
    per = {r["source"]: (r["target"], r["taken"]) for r in mixing.mix(a.union(b)).groupBy("source").agg({"target": "max", "taken": "sum"}).toDF("source", "target", "taken").collect()}
    assert per == {"a": (4500.0, 4500), "b": (9000.0, 9000)}


def test_sources_come_near_their_targets(spark, sf_dir):
    """Each source of the given documents is within 2 % of its target, or half of its smallest document that was not drawn."""
    rows = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).toPandas()
    for source, own in rows.groupby("source"):
        target, taken = own.target.iloc[0], own.taken.sum()
        whole = int(target // own["size"].sum())
        unused = own[(own.copies == whole) & (own["size"] > 0)]["size"].min()
        assert abs(taken - target) <= max(0.02 * target, unused / 2), source


def test_long_documents_are_drawn_more_often(spark):
    """Inclusion odds grow with size: of documents of 10 and 100 words about a tenth of the chance."""
    rows = [(i, "w " * (100 if i % 2 else 10), "a") for i in range(4000)] + [(10_000 + i, "w " * 50, "b") for i in range(2000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).filter("source = 'a'").toPandas()
    extra = got.copies - int(got.target.iloc[0] // got.source_size.iloc[0])
    short, long = extra[got["size"] == 10].mean(), extra[got["size"] == 100].mean()
    assert 0.05 < short / long < 0.2 and abs(got.taken.sum() - got.target.iloc[0]) <= 5
