"""Training-data operators against brute force, round trips, held-out labels and edge cases."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest import rows_of
from pyspark.sql import functions as F

from tracelake.llm import bpe, exact_dedup, langid, licenses, mixing, quality, queries, rules, simhash, suffix_array, suffix_dedup, toxicity
from tracelake.llm.common import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, hash string, copies long"
WORDS = "the quick brown fox jumps over lazy dogs while rain falls on hills near rivers and towns of stone".split()


def make(spark, rows):
    """Documents with extra columns whose names clash with those the operators make."""
    return spark.createDataFrame([(*r, 1, 7, "x", 9) for r in rows], SCHEMA)


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + str(rnd.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and blank texts, a very long one, ties and repeated rows."""
    rnd = random.Random(3)
    long = prose(rnd, 60_000)
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n ", None, None), (4, long, "en", "b"), (5, long, "en", None), (6, "same  text here", "en", "a"), (6, "same  text here", "en", "a"),
        (7, "same text\nhere", "en", "b"), (None, "same text here", None, "a"), (None, None, None, None), (8, "x", "fr", "b"), (9, "żółć \U0001f600 <|endoftext|>", "pl", "c"), (10, "...", "en", "c"),
    ]
    return make(spark, rows)


@pytest.fixture(scope="module")
def none(spark, odd):
    return odd.filter("false")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = queries.queries()[name](spark, sf_dir).toPandas()
    assert rows_of(got) == rows_of(duck.sql(queries.oracle_sql()[name]).df())


# ---- 1 toxicity, 2 quality


def held_out_scores(spark, sf_dir, name, label):
    got = queries.queries()[name](spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return got.join(labels, "doc_id").toPandas(), got.count(), spark.read.parquet(f"{sf_dir}/documents.parquet").count()


@pytest.mark.parametrize("name,label,mod,rest", [("op1_toxicity", "toxic", 4, 2), ("op2_quality", "quality", 5, 0)])
def test_classifiers_on_held_out_labels(spark, name, label, mod, rest):
    j, n, docs = held_out_scores(spark, "/root/testdata/sf0.01", name, label)
    assert n == docs and j["score"].between(0, 1).all()
    assert (j["held_out"] == [zlib.crc32(str(i).encode()) % mod == rest for i in j["doc_id"]]).all()
    h = j[j["held_out"]]
    assert ((h["score"] >= 0.3).astype(int) == h["predicted"]).all()
    assert (h["predicted"] == h[label]).mean() > 0.9


def test_classifiers_take_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (4, 1, 0), (5, None, None), (None, 1, 1), (8, 0, 1)], "doc_id long, quality int, toxic int")
    q = quality.fit(odd, labels)
    assert quality.score(odd, q).count() == 13 and quality.score(none, q).count() == 0
    assert quality.keep_good(odd, q).columns == odd.columns
    t = toxicity.fit(odd, labels)
    assert toxicity.score(odd, t).count() == 13 and toxicity.score(none, t).count() == 0
    assert quality.score(odd, quality.fit(none, labels)).count() == 13
    assert toxicity.score(odd, toxicity.fit(none, labels)).count() == 13


def test_nn_pu_finds_the_feature():
    rng = np.random.default_rng(0)
    p = np.c_[np.ones(200), rng.integers(0, 2, 200)].astype(np.float32)
    u = np.c_[np.r_[np.ones(50), np.zeros(450)], rng.integers(0, 2, 500)].astype(np.float32)
    w, b = toxicity.nn_pu(p, u, 0.1)
    assert w[0] + b > 0 > b and abs(w[1]) < w[0]


def test_discriminant_equals_densities():
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(0, 1, (300, 3)), rng.normal(2, 0.5, (300, 3))]
    y = np.r_[np.zeros(300), np.ones(300)]
    n = np.array([300, 300.0])
    sums = np.stack([x[y == c].sum(0) for c in (0, 1)])
    squares = np.stack([x[y == c].T @ x[y == c] for c in (0, 1)])
    m = quality.QuadraticDiscriminant.fit(n, sums, squares)
    cov = [f @ f.T for f in m.factors]
    logs = [-0.5 * (np.einsum("ij,jk,ik->i", x - mu, np.linalg.inv(s), x - mu) + np.linalg.slogdet(s)[1]) for mu, s in zip(m.means, cov)]
    assert np.allclose(m.score(x, 1.0), 1 / (1 + np.exp(logs[0] - logs[1])))
    assert ((m.score(x) > 0.5) == (y == 1)).mean() > 0.95


# ---- 3 mixing


def test_mix_of_odd_rows(spark, odd, none):
    got = mixing.mix(odd).toPandas()
    assert len(got) == 13 and (got["taken"] <= 3 * got["size"]).all()
    assert mixing.mix(none).count() == 0 and mixing.take(none).count() == 0
    assert mixing.take(odd).columns == odd.columns


def test_mix_comes_near_its_targets_with_a_hot_source(spark):
    rnd = random.Random(5)
    rows = [(i, prose(rnd, rnd.randrange(1, 60)), "en", "hot" if i % 3 == 0 else f"s{i % 11}") for i in range(3000)]
    docs = make(spark, rows)
    first = mixing.mix(docs).toPandas()
    again = mixing.mix(docs.repartition(7)).toPandas()
    key = ["doc_id", "taken"]
    assert first.sort_values("doc_id")[key].values.tolist() == again.sort_values("doc_id")[key].values.tolist()
    per = first.groupby("source").agg(size=("size", "sum"), taken=("taken", "sum"), target=("target", "first"))
    assert (abs(per["taken"] - per["target"]) <= 5).all() and abs(per["target"].sum() - per["size"].sum()) < 1e-6
    assert (per["target"] <= 3 * per["size"] + 1e-9).all()


def test_slices_do_not_change_the_mix(spark, monkeypatch):
    rnd = random.Random(6)
    docs = make(spark, [(i, prose(rnd, rnd.randrange(0, 30)), "en", f"s{i % 3}") for i in range(900)])
    want = rows_of(mixing.mix(docs).toPandas())
    monkeypatch.setattr(mixing, "SLICE_ROWS", 10)
    assert rows_of(mixing.mix(docs).toPandas()) == want


# ---- 4 near duplicates


def plain_simhash(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps, bits=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    best = {}
    for i, d in enumerate(ids):
        if d is not None:
            best[find(i)] = min(d, best.get(find(i), d))
    return [best.get(find(i)) for i in range(len(fps))]


def test_near_duplicates_by_brute_force(spark, sf_dir, odd, none):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    for table in (docs, odd):
        x = table.select("doc_id", "text").collect()
        fps = [plain_simhash(r["text"]) for r in x]
        want = sorted(map(repr, zip([r["doc_id"] for r in x], [f"{f:016x}" for f in fps], plain_components([r["doc_id"] for r in x], fps))))
        got = simhash.near_duplicates(table).collect()
        assert sorted(repr((r["doc_id"], r["fingerprint"], r["component_id"])) for r in got) == want
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


@pytest.mark.parametrize("tile", [5, 20_000])
def test_links_of_random_fingerprints(spark, tile):
    rnd = random.Random(7)
    base = [rnd.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:
        for _ in range(12):
            fps.add(b ^ sum(1 << i for i in rnd.sample(range(64), rnd.randrange(1, 6))))
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    roots = {r["node"]: r["root"] for r in connected_components(simhash.linked(df, tile=tile)).collect()}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = plain_components(signed, fps)
    assert [roots.get(s, s) for s in signed] == want


def test_every_anchor_pattern_reaches():
    for n in {n for _, n in simhash.BLOCKS}:
        patterns = simhash.error_patterns(n)
        rng = np.random.default_rng(2)
        x = rng.integers(0, 1 << n, 500)
        s = simhash.syndromes(x)
        for v, syn in zip(x.tolist(), s.tolist()):
            home = v ^ (1 << (syn - 1) if syn else 0)
            assert simhash.syndromes(np.array([home]))[0] == 0
            near = v ^ (1 << int(rng.integers(n)))
            reach = near ^ patterns[simhash.syndromes(np.array([near]))[0]]
            assert home in reach.tolist()


# ---- 5 exact duplicates


def test_exact_groups_of_odd_rows(odd, none):
    got = exact_dedup.assign_groups(odd).toPandas()
    assert len(got) == 13
    by = got.dropna(subset=["doc_id"]).set_index("doc_id")
    assert by.loc[[1.0, 2.0], "keep_id"].tolist() == [1, 1] and by.loc[7.0, "keep_id"] == 6 and by.loc[5.0, "keep_id"] == 4
    assert by.loc[3.0, "keep_id"] == 3 and by.loc[1.0, "text_sha256"] == hashlib.sha256(b"").hexdigest()
    assert exact_dedup.assign_groups(none).count() == 0
    assert sorted(r["doc_id"] for r in exact_dedup.deduplicate(odd).collect()) == [1, 3, 4, 6, 6, 8, 9, 10]


def test_colliding_hashes_are_told_apart(odd):
    weak = lambda text: F.unhex(F.substring(F.md5(text), 1, 0))
    assert rows_of(exact_dedup.assign_groups(odd, hash_of=weak).toPandas()) == rows_of(exact_dedup.assign_groups(odd).toPandas())


# ---- 6 licences


def test_licences(spark, odd, none):
    rnd = random.Random(8)
    notices = {1: "Released under the MIT License.", 2: "Licensed under the Apache License, Version 2.0.", 3: "This work is licensed under the GNU General Public License, version 3.", 4: "Licensed under CC BY-NC 4.0."}
    rows = [(i, prose(rnd, 40) + "\n" + notices.get(i, prose(rnd, 12)) + "\n" + prose(rnd, 30), "en", "a") for i in range(60)]
    docs = make(spark, rows)
    model = licenses.fit(licenses.background_sample(docs))
    got = {(r["doc_id"], r["paragraph"]): (r["family"], r["confirmed"]) for r in licenses.scan(docs, model).collect()}
    assert got == {(1, 1): ("MIT", True), (2, 1): ("Apache-2.0", True), (3, 1): ("GPL-3.0", True), (4, 1): ("CC-BY-NC", True)}
    assert licenses.scan(none, model).count() == 0 and licenses.scan(odd, model).count() == 0
    assert licenses.scan(docs.union(docs), model).count() == 8


# ---- 7 BPE


def test_bpe_equals_the_library(spark, sf_dir, odd, none):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t = Tokenizer.from_file(path)
    rnd = random.Random(9)
    alphabet = "abcdeé  \t\n'llXY  12٣,.#€漢字\U0001f600<|>"
    more = make(spark, [(100 + i, "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(80))) + ("<|endoftext|>" * (i % 3 == 0)) + "aaaaaaaaa" * (i % 4), "en", "a") for i in range(300)])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text")).union(more.select("doc_id", "text"))
    want = []
    for r in docs.collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        want.append(repr((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())))
    got = bpe.tokenize(docs, path).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(want)
    back = bpe.detokenize(bpe.tokenize(more, path, with_ids=True), path)
    assert rows_of(back.toPandas()) == rows_of(more.select("doc_id", "text").toPandas())
    assert bpe.tokenize(none, path).count() == 0


# ---- 8 language


def test_language_on_held_out_documents(spark, odd, none):
    got = queries.queries()["op8_language"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    j = got.join(docs, "doc_id").filter("held_out").toPandas()
    assert (j["lang"] == j["lang_pred"]).mean() > 0.97 and j["score"].between(0, 1).all()
    content = langid.dictionaries(odd)
    out = {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd, content).collect()}
    assert out[1] == out[2] == out[3] == out[10] == "und" and out[9] in content
    assert langid.identify(none, content).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, langid.dictionaries(none)).collect()} == {"und"}


# ---- 9 rules


def test_rules_on_odd_rows(odd, none):
    got = rules.judge(odd).toPandas()
    assert len(got) == 13 and got["base_failed"].sum() == 11
    assert rules.judge(none).count() == 0
    shuffled = rules.judge(odd, rules=tuple(reversed(rules.RULES))).toPandas()
    assert rows_of(got.drop(columns="rejected_by")) == rows_of(shuffled.drop(columns="rejected_by"))


def test_repeated_windows_by_brute_force(spark):
    rnd = random.Random(10)
    texts = [" ".join(rnd.choice("abcd") for _ in range(rnd.randrange(0, 40))) for _ in range(200)]
    got = {r["doc_id"]: r["n_repeat_words"] for r in rules.measure(make(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        grams = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        c = Counter(grams)
        assert got[i] == len({j + o for j, g in enumerate(grams) if c[g] > 1 for o in range(3)})


# ---- 10 repeated passages


def plain_repeats(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("length,max_contexts", [(200, 20_000), (40, 20_000), (40, 1)])
def test_repeats_by_brute_force(spark, odd, none, length, max_contexts):
    rnd = random.Random(11)
    passage = prose(rnd, 60)
    texts = [prose(rnd, 80) for _ in range(30)]
    texts += [t[: rnd.randrange(50, 200)] + passage + prose(rnd, 20) for t in texts[:12]] + [texts[0], texts[0], "ab" * 400, "xyz" * 90 + passage, passage[:300]]
    near = texts[5].split(" ")
    near[20] = "changed"
    texts.append(" ".join(near))
    docs = make(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    want = plain_repeats([t.encode() for t in texts], length)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.remove_repeats(docs, length=length, max_contexts=max_contexts).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_repeats_of_odd_rows(odd):
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(odd).collect()}
    assert got[4]["n_removed"] == got[4]["n_bytes"] == got[5]["n_removed"] and got[1]["n_bytes"] == 0 and got[6]["n_removed"] == 0


def test_suffix_arrays_by_sorting():
    rng = np.random.default_rng(4)
    for i in range(150):
        t = rng.integers(1, 2 + i % 5, rng.integers(1, 150))
        t = np.r_[np.tile(t, 1 + i % 3) * (400 if i % 7 == 0 else 1), 0]
        sa = suffix_array.suffix_array(t)
        text = t.tolist()
        want = sorted(range(len(text)), key=lambda j: text[j:])
        assert sa.tolist() == want
        plcp = suffix_array.permuted_lcp(t, sa)
        for a, b in zip(want, want[1:]):
            n = 0
            while max(a, b) + n < len(text) and text[a + n] == text[b + n]:
                n += 1
            assert plcp[b] == n


# ---- components


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got.values()) == {0, 1000} and len(got) == 111
    assert connected_components(spark.createDataFrame(edges, "a long, b long").filter("false")).count() == 0
