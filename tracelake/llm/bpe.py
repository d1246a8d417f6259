"""Byte-level BPE encoding and decoding with a pair occurrence index.

Spark splits texts into words with a regular expression in the JVM; an Arrow batch holds the words of
many documents. The distinct words of each part of it, some megabytes, are laid out in one array of symbols. An index maps each pair rank
to all positions where the pair occurs; the active ranks are taken in ascending order from a heap, all
occurrences of a rank merge at once, and the lists of the pairs next to them are updated.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unicode's White_Space characters, spelt out because Java's \s has only those of ASCII.
_S = r"\x09-\x0D\x20\x85\xA0" + "{}{}-{}{}{}{}{}{}".format(*map(chr, (0x1680, 0x2000, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: The split before merges that belongs to the vocabulary (fixed value).
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: Words of this many bytes of text are laid out at once, across documents.
PART_BYTES = 4 << 20


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte, by rule: printable Latin-1 stands for itself, the rest follow from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """Ids, bytes and merge ranks of a tokenizer file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.n = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes = [b""] * self.n
        for token, i in vocab.items():
            if token not in self.special:
                self.bytes[i] = bytes(alphabet[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.of_byte = np.zeros(256, np.int32)
        for c, b in alphabet.items():
            self.of_byte[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        key = np.array([vocab[a] * self.n + vocab[b] for a, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.left, self.right = (key // self.n).astype(np.int32), (key % self.n).astype(np.int32)
        order = np.argsort(key)
        self.keys, self.rank_of = key[order], order.astype(np.int32)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, -1 for none."""
        key = a.astype(np.int64) * self.n + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (b >= 0) & (a >= 0), self.rank_of[at], -1)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class PairIndex:
    """Positions of each active rank; a heap gives the ranks in ascending order."""

    def __init__(self):
        self.positions: dict[int, list[np.ndarray]] = {}
        self.heap: list[int] = []

    def add(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        known = ranks >= 0
        ranks, positions = ranks[known], positions[known]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]])
        for r, part in zip(ranks[cuts].tolist(), np.split(positions, cuts[1:])):
            if r not in self.positions:
                self.positions[r] = []
                heapq.heappush(self.heap, r)
            self.positions[r].append(part)

    def pop(self) -> tuple[int, np.ndarray]:
        r = heapq.heappop(self.heap)
        parts = self.positions.pop(r)
        return r, np.unique(np.concatenate(parts)) if len(parts) > 1 else np.sort(parts[0])


def encode_words(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in a row, and where each word's ids begin (one more entry at the end)."""
    if not words:
        return np.empty(0, np.int32), np.zeros(1, np.int64)
    data = np.frombuffer(b"".join(words), np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    symbols = vocab.of_byte[data]
    n = len(symbols)
    first = np.zeros(n + 1, bool)
    first[np.r_[0, np.cumsum(lengths)]] = True
    following = np.arange(1, n + 1, dtype=np.int32)
    following[first[1:]] = -1
    before = np.arange(-1, n - 1, dtype=np.int32)
    before[first[:-1]] = -1
    index = PairIndex()
    at = np.flatnonzero(following >= 0).astype(np.int32)
    index.add(vocab.ranks(symbols[at], symbols[at + 1]), at)
    while index.heap:
        rank, at = index.pop()
        a, b = vocab.left[rank], vocab.right[rank]
        nxt = following[at]
        good = (symbols[at] == a) & (nxt >= 0)
        good &= symbols[np.where(good, nxt, 0)] == b
        at, nxt = at[good], nxt[good]
        if a == b and len(at) > 1:
            # In a run of equal symbols every other pair merges, from the left.
            start = np.r_[True, nxt[:-1] != at[1:]]
            run = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
            odd = (np.arange(len(at)) - run) % 2 == 0
            at, nxt = at[odd], nxt[odd]
        if not len(at):
            continue
        after = following[nxt]
        symbols[at] = vocab.merged[rank]
        symbols[nxt] = -1
        following[at] = after
        inner = after >= 0
        before[after[inner]] = at[inner]
        prior = before[at]
        left, right = prior[prior >= 0], at[inner]
        index.add(vocab.ranks(symbols[left], symbols[following[left]]), left)
        index.add(vocab.ranks(symbols[right], symbols[following[right]]), right)
    alive = symbols >= 0
    upto = np.r_[0, np.cumsum(alive)]
    return symbols[alive], upto[np.r_[0, np.cumsum(lengths)]]


def decode(ids: Iterable[int], vocab: Vocabulary) -> bytes:
    """Bytes of a row of ids."""
    return b"".join([vocab.bytes[i] for i in ids])


def words_of(text: Column, special: tuple[str, ...] = ("<|endoftext|>",)) -> Column:
    """The words that are encoded one by one; special tokens in the text are words of their own."""

    def split(part: Column) -> Column:
        return F.regexp_extract_all(part, F.lit(SPLIT), F.lit(0))

    words = split(text)
    for token in special:
        parts = F.split(text, rf"\Q{token}\E", -1)
        cut = F.flatten(F.transform(parts, lambda p: F.concat(F.array(F.lit(token)), split(p))))
        words = F.when(F.contains(text, F.lit(token)), F.slice(cut, F.lit(2), F.greatest(F.size(cut) - 1, F.lit(0)))).otherwise(words)
    return words


def tokenize(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokens of every row: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``ids``.

    ``path`` is a byte-level BPE file in the tokenizers format, readable on every executor. Text is encoded as that
    library does without adding special tokens (their strings in a text become their ids), then the ids
    are decoded again. Null counts as empty; an empty text has no tokens. Nothing is cut, repeated rows
    are encoded alike, an empty table gives an empty result, other columns are not read.
    """
    special = tuple(vocabulary(path).special)
    rows = docs.select(F.col(id_col).alias("doc_id"), words_of(F.coalesce(F.col(text_col), F.lit("")), special).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                yield encode_batch(batch.column(0).slice(at, 1000), batch.column(1).slice(at, 1000), vocab, with_ids)
        pa.default_memory_pool().release_unused()

    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(run, schema + ", ids array<int>" * with_ids)


def _parts(words: pa.Array, most: int) -> Iterator[pa.Array]:
    """Cuts a column of words into parts of about ``most`` bytes; a longer word is a part of its own."""
    size = np.r_[0, np.cumsum(np.asarray(pc.binary_length(words), np.int64))]
    at = 0
    while at < len(words):
        to = max(at + 1, int(np.searchsorted(size, size[at] + most, "right")) - 1)
        yield words.slice(at, to - at)
        at = to


class Document:
    """Digests of one document's ids and decoded bytes, fed word after word."""

    def __init__(self):
        self.n, self.ids, self.decoded, self.all = 0, hashlib.sha256(), hashlib.sha256(), []

    def add(self, n: int, text: bytes, raw: bytes) -> None:
        if n:
            self.ids.update(b"," + text if self.n else text)
            self.decoded.update(raw)
            self.n += n


def encode_part(words: pa.Array, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, list[bytes], list[bytes], np.ndarray]:
    """(ids of the distinct words in a row, their starts, id texts, decoded bytes, code of each word)."""
    coded = words.dictionary_encode()
    distinct = coded.dictionary.cast(pa.binary()).to_pylist()
    special = {token.encode(): i for token, i in vocab.special.items()}
    whole = np.array([w in special for w in distinct], bool)
    ids, cuts = encode_words([w for w in distinct if w not in special], vocab)
    length = np.ones(len(distinct), np.int64)
    length[~whole] = np.diff(cuts)
    starts = np.r_[0, np.cumsum(length)]
    all_ids = np.empty(starts[-1], np.int32)
    own = np.repeat(whole, length)
    all_ids[~own] = ids
    all_ids[own] = [special[w] for w in distinct if w in special]
    lists = list(zip(starts[:-1].tolist(), starts[1:].tolist()))
    names = all_ids.tolist()
    texts = [",".join(map(str, names[a:b])).encode() for a, b in lists]
    # A word is valid UTF-8, so decoding word by word replaces what decoding the whole text would.
    raw = [decode(names[a:b], vocab).decode("utf-8", "replace").encode() for a, b in lists]
    return all_ids, starts, texts, raw, coded.indices.to_numpy()


def encode_batch(doc_ids: pa.Array, texts: pa.Array, vocab: Vocabulary, with_ids: bool) -> pa.RecordBatch:
    """Encodes the distinct words of each part of a batch once and puts the documents together from them.

    Parts pay no heed to documents: a long text goes through many, and its digests grow with each.
    """
    offsets = np.asarray(texts.offsets, np.int64)
    ends = (offsets - offsets[0])[1:]
    docs = [Document() for _ in range(len(texts))]
    done, at = 0, 0
    for part in _parts(texts.flatten(), PART_BYTES):
        all_ids, starts, id_texts, raw, codes = encode_part(part, vocab)
        begin = 0
        while begin < len(codes):
            while ends[at] <= done:
                at += 1
            end = min(len(codes), begin + int(ends[at]) - done)
            own = codes[begin:end]
            n = int((starts[own + 1] - starts[own]).sum())
            words = own.tolist()
            docs[at].add(n, b",".join([id_texts[c] for c in words]), b"".join([raw[c] for c in words]))
            if with_ids:
                docs[at].all.extend(all_ids[starts[c] : starts[c + 1]] for c in words)
            done += end - begin
            begin = end
    columns = [doc_ids, pa.array([d.n for d in docs], pa.int64()), *(pa.array([h.hexdigest() for h in hashes], pa.string()) for hashes in ([d.ids for d in docs], [d.decoded for d in docs]))]
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    if with_ids:
        columns.append(pa.array([np.concatenate(d.all) if d.all else [] for d in docs], pa.list_(pa.int32())))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names)


def detokenize(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` of rows with a column of ids; null ids give null, unknown ids fail."""
    rows = tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            texts = [None if (x := row.as_py()) is None else decode(x, vocab).decode("utf-8", "replace") for row in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text string")
