"""Scores of the fitted models against plain versions of their definitions."""

import math
import re

import numpy as np
import pytest
import zstandard

from tracelake.llm import langid, quality, toxicity
from tracelake.llm.common import id_remainder


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"), spark.read.parquet(f"{sf_dir}/labels.parquet")


def test_toxicity_scores(tables):
    docs, labels = tables
    model = toxicity.fit(docs, labels)
    assert model.vocabulary and len(model.vocabulary) <= toxicity.MAX_FEATURES
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    for r in docs.collect():
        words = {w for w in re.split(r"[\W\d_]+", (r["text"] or "").lower()) if w}
        z = model.bias
        for feature, i in model.vocabulary.items():
            held = any(len(w) > len(feature) - 1 and w.startswith(feature[:-1]) for w in words) if feature.endswith("*") else feature in words
            z += model.weights[i] * held
        assert abs(got[r["doc_id"]] - 1 / (1 + math.exp(-z))) < 1e-9


def test_risk_by_hand():
    """One step of the fit goes down the corrected risk; with a negative corrected part it goes up along that."""
    p, u = np.array([[1.0], [1.0]], np.float32), np.array([[1.0], [0.0], [0.0]], np.float32)

    def risk(w, b, prior):
        soft = lambda z: np.logaddexp(0, z)
        gp, gu = p @ w + b, u @ w + b
        return prior * soft(-gp).mean(), soft(gu).mean() - prior * soft(gp).mean()

    w0, b0 = toxicity.nn_pu(p, u, 0.3, epochs=1, rate=1e-3)
    before, after = sum(risk(np.zeros(1), 0.0, 0.3)), sum(risk(w0, b0, 0.3))
    assert after < before
    w, b = toxicity.nn_pu(p, u, 0.3, epochs=400)
    assert risk(w, b, 0.3)[1] > -0.05


def test_quality_statistics(tables):
    """Counts, sums and products over tasks equal those of all rows at once."""
    docs, labels = tables
    model = quality.fit(docs, labels, fit_rows=1 << 40)  # no two ids in one bucket
    joined = docs.join(labels.filter("quality in (0, 1)"), "doc_id").collect()
    packer = zstandard.ZstdCompressor(level=1)
    x = np.array([quality.statistics(r["text"], packer) for r in joined])
    y = np.array([r["quality"] for r in joined])
    want = quality.QuadraticDiscriminant.fit(np.array([(y == c).sum() for c in (0, 1)], float), np.stack([x[y == c].sum(0) for c in (0, 1)]), np.stack([x[y == c].T @ x[y == c] for c in (0, 1)]))
    assert np.allclose(model.means, want.means) and np.allclose(model.factors, want.factors) and np.allclose(model.log_priors, want.log_priors)


def test_language_by_plain_compression(tables):
    docs, _ = tables
    content = langid.dictionaries(docs.filter(id_remainder("doc_id", 3) != 1))
    assert all(len(c) <= langid.BUCKETS * (4 * langid.EXCERPT_CHARS + 1) for c in content.values())
    packers = {}
    for lang, data in content.items():
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        packers[lang] = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)
    got = {r["doc_id"]: (r["lang_pred"], r["rejected"]) for r in langid.identify(docs, content).collect()}
    different = 0
    for r in docs.collect():
        plain = " ".join(w for w in re.split(r"[\W\d_]+", (r["text"] or "").lower()) if w)
        if not any(c.isalpha() for c in plain):
            assert got[r["doc_id"]] == ("und", True)
            continue
        size = {lang: sum(len(c.compress(plain[i : i + langid.PIECE].encode())) for i in range(0, len(plain), langid.PIECE)) for lang, c in packers.items()}
        first, second = sorted(size, key=lambda k: (size[k], k))[:2]
        if (size[second] - size[first]) / size[first] >= 2 * langid.MIN_MARGIN:
            assert got[r["doc_id"]] == (first, False)
        different += got[r["doc_id"]][0] != first
    assert different <= 0.01 * len(got)
