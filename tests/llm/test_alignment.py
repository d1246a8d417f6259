"""Alignment of two tokenizers against a plain version over whole texts with the libraries themselves."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from test_operators import make, none, odd  # noqa: F401
from test_packing import random_texts
from tokenizers import Tokenizer

from tracelake.llm import alignment, bpe, queries

PATHS = queries.tokenizer_path(queries.RANKS), queries.tokenizer_path(queries.PIECES)


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(queries.tokenizer_path())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def plain(texts, libraries):
    """The contract, text by text and link by link."""
    lib_a, lib_b = libraries
    alphabet = bpe.byte_alphabet()
    rows, count = [], Counter()
    for text in texts:
        if not text:
            rows.append(None)
            continue
        raw = (" " + text).encode()
        enc = lib_a.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(alphabet[c] for c in t)) for i, t in zip(enc.ids, enc.tokens)]
        b = [(i, bytes([int(lib_b.id_to_piece(i)[3:5], 16)]) if lib_b.is_byte(i) else lib_b.id_to_piece(i).replace("▁", " ").encode()) for i in lib_b.encode(text)]
        if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            rows.append(None)
            continue
        ends = [np.cumsum([len(x) for _, x in t]).tolist() for t in (a, b)]
        common = sorted(set(ends[0]) & set(ends[1]))
        place = {end: k for k, end in enumerate(common)}
        groups = [([], []) for _ in common]
        for side, (tokens, es) in enumerate(zip((a, b), ends)):
            k = 0
            for (i, _), e in zip(tokens, es):
                groups[k][side].append(i)
                k += e in place
        links = Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        count.update(links.keys())
        rows.append((len(a), len(b), groups, links))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for row in rows:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = row
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((n_a, n_b, len(groups), sum(links.values()), sum(n for p, n in links.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest()))
    return out


def result(df):
    return [tuple(r) for r in df.orderBy("doc_id").collect()]


def test_given_documents(spark, sf_dir, libraries):
    local = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").toPandas()
    got = result(queries.queries()["op12_alignment"](spark, sf_dir))
    assert got == [(d, *r) for d, r in zip(local.doc_id.tolist(), plain(local.text.tolist(), libraries))]


@pytest.mark.parametrize("dense", [256, 2])
def test_random_texts(spark, libraries, dense, monkeypatch):
    monkeypatch.setattr(alignment, "DENSE", dense)
    rnd = random.Random(4)
    texts = random_texts(6, 900) + ["".join(rnd.choice("ab\U0001f600é中\x00") for _ in range(400)) for _ in range(10)] + ["", None, " ", "a▁b"]
    rnd.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert result(alignment.align(docs, *PATHS)) == [(i, *r) for i, r in enumerate(plain(texts, libraries))]


def test_odd_rows(spark, odd, none, libraries):  # noqa: F811
    local = odd.select("doc_id", "text").collect()
    want = plain([r["text"] for r in local], libraries)
    got = [tuple(r) for r in alignment.align(odd, *PATHS).collect()]
    assert sorted(map(repr, got)) == sorted(repr((r["doc_id"], *w)) for r, w in zip(local, want))
    assert alignment.align(none, *PATHS).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 30_000])
def test_perfect_hash(n):
    rnd = np.random.default_rng(n)
    keys = np.unique(rnd.integers(0, 2**32, n, dtype=np.uint32))
    perfect = alignment.PerfectHash.from_bytes(alignment.PerfectHash.build(keys).to_bytes())
    assert sorted(perfect.slots(keys).tolist()) == list(range(len(keys)))
    by_slot = np.empty_like(keys)
    by_slot[perfect.slots(keys)] = keys
    if n > 1:
        with pytest.raises(ValueError):
            alignment.verified(perfect, by_slot, np.setdiff1d(np.arange(50, dtype=np.uint32), keys))
