"""Packing of documents into sequences by sum-of-squares online packing.

Each task packs the documents of its partition as they come. A level array holds how many partially filled windows
have each fill level; a document goes to the level where the sum of the squared counts grows least. Documents of more
than a window fill whole windows first, and only their rest is placed. When more windows are open than a task may
hold, and at the end of a partition, what is open is cut anew into full windows; the last rest goes into
sequences whose lengths are powers of two, which need no padding. So no sequence is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .units import byte_bpe, cut, ragged

WINDOW = 2048
#: Id that ends each document.
END_ID = 1
#: Partially filled windows that a task holds; beyond it they are cut into full ones.
MAX_OPEN = 512
#: Bytes of text that are encoded at once.
PART_BYTES = 4 << 20
#: Sequences a partition may number.
PER_PARTITION = 1 << 40
ROWS = 10_000


class Lexicon:
    """Ids of units, kept from one part of a partition to the next; it starts anew when it has too many."""

    MOST = 700_000

    def __init__(self, coder):
        self.coder = coder
        self.clear()

    def clear(self) -> None:
        self.inner: dict[str, int] = {}
        self.first: dict[str, int] = {}
        self.ids, self.begin, self.count = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def documents(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each)."""
        if len(self.inner) + len(self.first) > self.MOST:
            self.clear()
        units = cut(texts)
        inner, first = self.inner.get, self.first.get
        known = np.array([inner(s, -1) for s in units.strings[: units.plain]] + [first(s, -1) for s in units.strings[units.plain :]], np.int64)
        new = np.flatnonzero((known < 0) & units.used)
        names = [units.strings[i] for i in new.tolist()]
        n = int(np.searchsorted(new, units.plain))
        ids, counts = self.coder.encode([" " + s for s in names[:n]] + names[n:], units.clean[new])
        known[new] = np.arange(len(new)) + len(self.count)
        codes = known[new].tolist()
        self.inner.update(zip(names[:n], codes[:n]))
        self.first.update(zip(names[n:], codes[n:]))
        self.begin = np.r_[self.begin, len(self.ids) + np.cumsum(counts) - counts]
        self.ids, self.count = np.r_[self.ids, ids], np.r_[self.count, counts]
        own = known[units.codes]
        counts = self.count[own]
        total = np.r_[0, np.cumsum(counts)][units.starts]
        return self.ids[ragged(self.begin[own], counts)], np.diff(total)


class Windows:
    """Open windows by fill level, and the rows of closed ones.

    A piece is ``(document, start, ids, tokens of the document)``.
    """

    def __init__(self, first_id: int, window: int = WINDOW, max_open: int = MAX_OPEN):
        self.next_id, self.window, self.max_open = first_id, window, max_open
        self.counts = np.zeros(window + 1, np.int64)
        self.at: list[list[list[tuple]]] = [[] for _ in range(window + 1)]
        self.open = 0
        self.rows: list[tuple] = []

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, tokens in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), tokens, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def level_for(self, size: int) -> int:
        """The fill level, 0 for a new window, where one more piece of ``size`` adds least to the sum of squares; of equals the fullest."""
        n, reach = self.counts, self.window - size
        cost = np.full(reach + 1, np.iinfo(np.int64).max)
        cost[0] = 2 * n[size] + 1
        used = np.flatnonzero(n[1 : reach + 1]) + 1
        cost[used] = 2 * (n[used + size] - n[used]) + 2
        if reach and n[reach]:
            cost[reach] = 1 - 2 * n[reach]
        return reach - int(np.argmin(cost[::-1]))

    def put(self, level: int, pieces: list[tuple], size: int) -> None:
        if level + size == self.window:
            self.close(pieces)
            return
        self.at[level + size].append(pieces)
        self.counts[level + size] += 1
        self.open += 1

    def add(self, doc, ids: np.ndarray) -> None:
        """Place one document."""
        whole = len(ids) // self.window * self.window
        for a in range(0, whole, self.window):
            self.close([(doc, a, ids[a : a + self.window], len(ids))])
        size = len(ids) - whole
        if not size:
            return
        piece = (doc, whole, ids[whole:].copy(), len(ids))
        level = self.level_for(size)
        pieces = []
        if level:
            pieces = self.at[level].pop()
            self.counts[level] -= 1
            self.open -= 1
        pieces.append(piece)
        self.put(level, pieces, size)
        if self.open > self.max_open:
            rest = self.cut_anew()
            if rest:
                self.put(0, rest, sum(len(p[2]) for p in rest))

    def cut_anew(self) -> list[tuple]:
        """Closes what is open in full windows, in the order of levels; the pieces of the last, part-filled one are left."""
        todo = [p for level in range(self.window, 0, -1) for pieces in self.at[level] for p in pieces]
        self.at = [[] for _ in range(self.window + 1)]
        self.counts[:] = 0
        self.open = 0
        return self.fill(todo, self.window)

    def fill(self, todo: list[tuple], most: int) -> list[tuple]:
        """Closes sequences of exactly ``most`` ids made from ``todo`` in order; the pieces left over."""
        now, size = [], 0
        for doc, start, ids, tokens in todo:
            at = 0
            while at < len(ids):
                part = ids[at : at + most - size]
                now.append((doc, start + at, part, tokens))
                at += len(part)
                size += len(part)
                if size == most:
                    self.close(now)
                    now, size = [], 0
        return now

    def finish(self) -> None:
        rest = self.cut_anew()
        left = sum(len(p[2]) for p in rest)
        while left:
            most = 1 << (left.bit_length() - 1)
            taken, todo, size = [], [], 0
            for doc, start, ids, tokens in rest:
                part = ids[: most - size]
                if len(part):
                    taken.append((doc, start, part, tokens))
                if len(part) < len(ids):
                    todo.append((doc, start + len(part), ids[len(part) :], tokens))
                size += len(part)
            self.close(taken)
            rest, left = todo, left - most

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def parts(texts: pa.Array, most: int = PART_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes; a longer text is a range of its own."""
    import pyarrow.compute as pc

    size = np.r_[0, np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))]
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(size, size[at] + most, "right")) - 1)
        yield at, to
        at = to


def pack(docs: DataFrame, ranks_path: str, special: dict[str, int], id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, max_open: int = MAX_OPEN) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``ranks_path`` is a byte-level vocabulary as ranks; strings of ``special`` in a text become their ids. Each
    document is its ids and then ``END_ID``; null and empty texts are that id alone. Every id lies in exactly one
    piece; sequences hold ``window`` ids or a power of two, none is padded. Documents are placed partition by partition: sequence
    ids are the partition's number and a running number, so a lost task gives the same rows again. Repeated rows and
    null ids are documents of their own, an empty table gives an empty result, other columns are not read.
    """
    if window & (window - 1):
        raise ValueError("the window is a power of two")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    special_items = tuple(sorted(special.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(byte_bpe(ranks_path, special_items))
        windows = Windows(TaskContext.get().partitionId() * PER_PARTITION, window, max_open)
        id_type = None
        end = np.array([END_ID], np.uint32)

        def made() -> pa.RecordBatch:
            columns = list(zip(*windows.take()))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            id_type = batch.column(0).type
            for a, b in parts(batch.column(1)):
                ids, counts = lexicon.documents(batch.column(1).slice(a, b - a))
                ends = np.cumsum(counts)
                for doc, i, j in zip(batch.column(0).slice(a, b - a).to_pylist(), (ends - counts).tolist(), ends.tolist()):
                    windows.add(doc, np.concatenate((ids[i:j], end)))
                if len(windows.rows) >= ROWS:
                    yield made()
        windows.finish()
        if windows.rows:
            yield made()

    return rows.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
