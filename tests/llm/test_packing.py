"""Packing against the tokenizers library, and the sum-of-squares rule against its definition."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_operators import SCHEMA, make, none, odd  # noqa: F401
from tokenizers import Tokenizer

from tracelake.llm import packing, queries, units

SPACES = [" ", "  ", "\n", "\t", "\xa0", "\x85", "　", "​", "᠎", "\x1c", "\r\n"]
BITS = ["a", "The", "'s", "'ll", " 12", "é", "<|endoftext|>", "#$", "\U0001f600", "▁", "<0x41>", "</s>", ".", "中文", "ﬁ", "\0"]


def random_texts(seed, n):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(rnd.choice([SPACES, BITS, [" "]])) for _ in range(rnd.randrange(25))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.tokenizer_path())


def check(rows, ids_of, window):
    """Each id in one piece, sequences gapless and full or a power of two, digests right."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert set(by_doc) == set(ids_of)
    for doc, own in by_doc.items():
        own.sort(key=lambda r: r["start"])
        ids, at = ids_of[doc], 0
        for r in own:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert r["start"] == at and len(part) == r["length"] > 0 and zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids)
            at += r["length"]
        assert at == len(ids)
    for own in by_seq.values():
        own.sort(key=lambda r: r["offset"])
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        assert at == window or at & (at - 1) == 0 and at < window


def test_units_give_the_ids_of_the_library(library):
    import pyarrow as pa

    coder = units.byte_bpe(queries.tokenizer_path(queries.RANKS), tuple(queries.SPECIAL.items()))
    texts = random_texts(5, 4000)
    lexicon = packing.Lexicon(coder)
    for part in (texts[:1500], texts[1000:], []):
        ids, counts = lexicon.documents(pa.array(part, pa.string()))
        want = [x.ids for x in library.encode_batch(part, add_special_tokens=False)]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("window, max_open", [(2048, 512), (64, 3)])
def test_pieces_of_all_documents(spark, sf_dir, library, window, max_open):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack(docs.repartition(3), queries.tokenizer_path(queries.RANKS), queries.SPECIAL, window=window, max_open=max_open).collect()
    local = docs.select("doc_id", "text").toPandas()
    ids_of = {d: [*e.ids, packing.END_ID] for d, e in zip(local.doc_id.tolist(), library.encode_batch([t or "" for t in local.text], add_special_tokens=False))}
    check(rows, ids_of, window)
    # Without padding the sequences are as few as their lengths allow, and a few short ones a partition.
    lengths = Counter()
    for r in rows:
        lengths[r["sequence_id"]] += r["length"]
    assert sum(n < window for n in lengths.values()) <= 3 * window.bit_length()


def test_query(spark, sf_dir):
    got = queries.queries()["op13_packing"](spark, sf_dir)
    assert got.select("doc_id").distinct().count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_odd_rows(spark, odd, none, library):  # noqa: F811
    path = queries.tokenizer_path(queries.RANKS)
    rows = packing.pack(odd, path, queries.SPECIAL).collect()
    local = odd.select("doc_id", "text").collect()
    want = sum(1 + len(library.encode(r["text"] or "", add_special_tokens=False).ids) for r in local)
    assert sum(r["length"] for r in rows) == want
    assert [(r["length"], r["doc_tokens"]) for r in rows if r["doc_id"] in (1, 2)] == [(1, 1)] * 2
    assert packing.pack(none, path, queries.SPECIAL).count() == 0
    again = packing.pack(odd, path, queries.SPECIAL).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_level_adds_least_squares():
    rnd = random.Random(8)
    windows = packing.Windows(0, 32, 10**9)
    for k in range(600):
        size = rnd.choice([3, 5, 7, 11, 13, 17, 29, 32])
        before = windows.counts.copy()
        best = []
        for level in range(0, 33 - size):
            if level and not before[level]:
                continue
            n = before.copy()
            if level:
                n[level] -= 1
            if level + size < 32:
                n[level + size] += 1
            best.append(((n[:32] ** 2).sum(), -level))
        if size < 32:
            assert windows.level_for(size) == -min(best)[1]
        windows.add(k, np.ones(size, np.uint32))
        assert windows.open == windows.counts.sum() == sum(map(len, windows.at))
    windows.finish()
    assert sum(r[2] for r in windows.rows) + 0 == sum(r[4] for r in windows.rows if r[1] == 0)
