"""The corpus pipeline stage by stage, each on the input it gets."""

import hashlib
import re

import pytest

import corpus_pipeline as P
from tracelake.llm import mixing, quality
from tracelake.llm.common import id_remainder


@pytest.fixture(scope="module")
def stages(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = [docs]
    for _, stage in P.STAGES:
        kept.append(P.materialise(stage(spark, kept[-1], sf_dir)))
    return sf_dir, kept


def test_stages_keep_the_columns(stages):
    _, kept = stages
    assert len(P.STAGES) == 5
    assert all(k.columns == kept[0].columns for k in kept[:-1])


def test_quality_stage(spark, stages):
    sf_dir, kept = stages
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas().set_index("doc_id")["quality"]
    left = {r["doc_id"] for r in kept[1].collect()}
    good = [d for d, q in labels.items() if q == 1]
    bad = [d for d, q in labels.items() if q == 0]
    assert sum(d in left for d in good) >= 0.98 * len(good) and sum(d in left for d in bad) <= 0.2 * len(bad)
    model = quality.fit(kept[0].filter(id_remainder("doc_id", 5) != 0), spark.read.parquet(f"{sf_dir}/labels.parquet").filter(id_remainder("doc_id", 5) != 0))
    assert left == {r["doc_id"] for r in quality.score(kept[0], model).filter("score >= 0.3").collect()}


def test_exact_stage(stages):
    _, kept = stages
    best = {}
    for r in kept[1].collect():
        text = re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")
        best[text] = min(r["doc_id"], best.get(text, r["doc_id"]))
    assert sorted(best.values()) == sorted(r["doc_id"] for r in kept[2].collect())


def test_near_stage(stages):
    """The stage joins texts by 5-word Jaccard similarity of at least 0.8, not by the 4-word fingerprints of the op4 query."""
    from test_near_copies import kept_by_jaccard

    _, kept = stages
    assert kept_by_jaccard(kept[2].select("doc_id", "text").collect()) == sorted((r["doc_id"] for r in kept[3].collect()), key=repr)


def test_mix_stage(stages):
    _, kept = stages
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(kept[3]).collect() if r["copies"]}
    got: dict = {}
    for r in kept[4].collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == want


def test_token_stage(stages):
    _, kept = stages
    texts = {r["doc_id"]: hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in kept[4].collect()}
    rows = kept[5].collect()
    assert len(rows) == kept[4].count() and all(texts[r["doc_id"]] == r["decoded_sha256"] for r in rows)


def test_empty_documents(spark, stages):
    sf_dir, kept = stages
    docs = kept[0].filter("false")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0
