"""The pipeline's near-duplicate stage against brute-force Jaccard similarity."""

import random

import corpus_pipeline as P
import pytest
from test_operators import make, none, odd, prose  # noqa: F401

from tracelake.llm import near_copies


def kept_by_jaccard(rows):
    """Smallest id of each component of pairs with 5-word Jaccard of at least 0.8."""
    sets = []
    for r in rows:
        words = (r["text"] or "").encode().lower().split()
        sets.append({b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if min(len(x), len(y)) * 5 < max(len(x), len(y)) * 4:
                continue
            both = len(x & y)
            if x == y or 5 * both >= 4 * (len(x) + len(y) - both):
                root[find(i)] = find(j)
    best = {}
    for i, r in enumerate(rows):
        best.setdefault(find(i), []).append(r["doc_id"])
    least = {i: min((d for d in ids if d is not None), default=None) for i, ids in best.items()}
    return sorted((r["doc_id"] for i, r in enumerate(rows) if r["doc_id"] == least[find(i)]), key=repr)


def got(docs):
    return sorted((r["doc_id"] for r in P.without_near_copies(docs.sparkSession, docs, "").collect()), key=repr)


def test_stage_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = kept_by_jaccard(rows)
    assert got(docs) == want and len(want) < len({r["text"] for r in rows})


def test_odd_rows(odd, none):  # noqa: F811
    assert got(odd) == kept_by_jaccard(odd.select("doc_id", "text").collect()) and got(none) == []


@pytest.mark.parametrize("common", [1, 3])
def test_families_that_share_passages(spark, monkeypatch, common):
    """Copies with words changed, around the threshold, all holding one passage; chains and a large family among them."""
    monkeypatch.setattr(near_copies, "COMMON_IN_SAMPLE", common)
    if common == 1:
        # Every large group is cut into tiles.
        monkeypatch.setattr(near_copies, "TILE", 7)
    rnd = random.Random(11)
    passage = prose(rnd, 12).split()
    rows = []
    for family in range(25):
        words = prose(rnd, 70).split()
        for _ in range(40 if family == 0 else 6):
            if rnd.random() < 0.7:
                words = list(words)
            else:
                words = prose(rnd, rnd.randrange(1, 40)).split()
            for _ in range(rnd.randrange(0, 4)):
                words[rnd.randrange(len(words))] = f"w{rnd.randrange(10**6)}"
            rows.append((len(rows), " ".join(words + passage), "en", "a"))
    rnd.shuffle(rows)
    docs = make(spark, rows)
    want = kept_by_jaccard(docs.collect())
    assert got(docs) == want and 30 < len(want) < len(rows)


def test_a_family_in_pieces_makes_few_pairs(spark, monkeypatch):
    """Where the first comparison joins nothing, a family grows together over some pairs a row, not over all."""
    rnd = random.Random(5)
    words = prose(rnd, 120).split()
    rows = []
    for i in range(150):
        own = list(words)
        own[rnd.randrange(len(own))] = f"w{i}"
        rows.append((i, " ".join(own), "en", "a"))
    docs = make(spark, rows)
    pairs, confirmed = [], near_copies.confirmed
    nothing = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(near_copies, "anchor_pairs", lambda distinct: nothing)
    monkeypatch.setattr(near_copies, "_chained", lambda similarity: lambda batches: iter(()))
    monkeypatch.setattr(near_copies, "confirmed", lambda found, *rest: (pairs.append(found.count()), confirmed(found, *rest))[1])
    assert got(docs) == kept_by_jaccard(docs.collect()) == [0]
    assert 0 < sum(pairs) < 150 * 100
