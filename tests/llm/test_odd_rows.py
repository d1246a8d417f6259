"""Extra columns with clashing names, repeated rows, hot anchors and folders, one case each."""

import random

import pytest
from pyspark.sql import functions as F
from test_operators import plain_repeats, prose

import corpus_pipeline as P
from tracelake.llm import bpe, common, exact_dedup, langid, licenses, mixing, near_copies, quality, queries, rules, simhash, suffix_dedup, toxicity

NAMES = ["keep_id", "label", "toxic", "copies", "fp", "mark", "hash", "size", "kept", "component_id", "ranges", "words", "sid", "gram", "root", "at", "value", "target", "anchor"]


@pytest.fixture(scope="module")
def clashing(spark):
    """Documents whose extra columns have the names that operators make."""
    rnd = random.Random(21)
    rows = [(i, prose(rnd, 60), "en", f"s{i % 3}", *(["x"] * len(NAMES))) for i in range(40)]
    rows += [(100 + i, rows[i][1], *rows[i][2:]) for i in range(5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in NAMES))


def test_clashing_names(spark, clashing):
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    model = quality.fit(clashing, labels)
    assert quality.score(clashing, model).count() == 45 and quality.keep_good(clashing, model).columns == clashing.columns
    assert toxicity.score(clashing, toxicity.fit(clashing, labels)).count() == 45
    assert mixing.mix(clashing).count() == 45 and mixing.take(clashing).columns == clashing.columns
    assert simhash.near_duplicates(clashing).count() == 45 and simhash.keep_one(clashing).columns == clashing.columns
    assert exact_dedup.assign_groups(clashing).count() == 45
    kept = exact_dedup.deduplicate(clashing)
    assert kept.count() == 40 and kept.columns == clashing.columns
    near = near_copies.keep_one(clashing)
    assert near.count() == 40 and near.columns == clashing.columns
    assert licenses.scan(clashing, licenses.fit(licenses.background_sample(clashing))).count() == 0
    assert bpe.tokenize(clashing, queries.tokenizer_path()).count() == 45
    assert langid.identify(clashing, langid.dictionaries(clashing)).count() == 45
    assert rules.judge(clashing).count() == 45 and suffix_dedup.remove_repeats(clashing).count() == 45


def test_pipeline_of_odd_rows(spark, clashing):
    """Every stage takes nulls, blanks, repeated rows and clashing names, and keeps the columns."""
    odd = spark.createDataFrame([(None, None, None, None), (200, "", None, "a"), (201, " \n", "en", None), (202, "same words " * 40, "en", "a"), (202, "same words " * 40, "en", "a")], "doc_id long, text string, lang string, source string")
    docs = clashing.unionByName(odd, allowMissingColumns=True)
    columns = docs.columns
    for i, (_, stage) in enumerate(P.STAGES):
        docs = P.materialise(stage(spark, docs, "/root/testdata/sf0.001"))
        assert i == len(P.STAGES) - 1 or docs.columns == columns
    assert "n_tokens" in docs.columns


def test_one_row_is_added_to_a_mix(spark):
    """Ten rows with a null id and one size: the mix takes what its targets ask for, not all of them."""
    rows = [(None, "one two three four five six seven eight nine ten", "a")] * 10 + [(i, "w " * 50, "b") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    per = {r["source"]: (r["target"], r["taken"]) for r in mixing.mix(docs).groupBy("source").agg(F.max("target").alias("target"), F.sum("taken").alias("taken")).collect()}
    # One of ten rows nearest to the target; of the long documents one more or less.
    assert abs(per["a"][1] - per["a"][0]) <= 5 and abs(per["b"][1] - per["b"][0]) <= 25


def test_repeated_ids_teach_once(spark):
    """An id that a thousand rows repeat is one example."""
    rnd = random.Random(22)
    rows = [(1, "vile awful words " + str(i)) for i in range(1000)] + [(i, prose(rnd, 20)) for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == len(rows)


@pytest.mark.parametrize("max_contexts", [1, 7])
def test_hot_anchor_by_brute_force(spark, max_contexts):
    """A phrase that hundreds of different texts hold, some with longer passages in common around it."""
    rnd = random.Random(23)
    phrase = "zzzzzzzz the very same phrase in all zzzzzzzz"
    around = [prose(rnd, 25) for _ in range(6)]
    texts = [prose(rnd, 15) + phrase + prose(rnd, 15) for _ in range(150)] + [prose(rnd, 5) + rnd.choice(around) + phrase + rnd.choice(around) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.remove_repeats(docs, length=60, max_contexts=max_contexts).collect()}
    assert [got[i] for i in range(len(texts))] == plain_repeats([t.encode() for t in texts], 60)


def test_folder_of_tables(spark):
    written = common.materialise(spark.range(3))
    assert written._written_to.startswith(spark.conf.get("spark.checkpoint.dir"))
    common.discard(written)
    with pytest.raises(Exception):
        spark.read.parquet(written._written_to)


def test_many_repeated_rows_are_searched_once(spark):
    """Two thousand rows of one id and text, and one text that overlaps it: contexts are those of two texts."""
    rnd = random.Random(29)
    text, other = prose(rnd, 120), prose(rnd, 40)
    overlap = other + text[100:900] + prose(rnd, 40)
    rows = [(None, text)] * 2000 + [(7, text)] * 50 + [(8, overlap), (8, other), (None, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    binary = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    assert suffix_dedup.collapsed(binary).count() == 5
    got = {}
    for r in suffix_dedup.remove_repeats(docs, length=60).collect():
        got.setdefault((r["doc_id"], r["n_bytes"]), []).append(tuple(r)[2:4])
    assert sum(map(len, got.values())) == len(rows) and all(len(set(v)) == 1 for v in got.values())
    want = plain_repeats([t.encode() for t in (text, text, text, overlap, other, other)], 60)
    for key, w in zip([(None, len(text.encode())), (7, len(text.encode())), None, (8, len(overlap.encode())), (8, len(other.encode())), (None, len(other.encode()))], want):
        assert key is None or got[key][0] == tuple(w)[1:3]
