"""Units of text that two tokenizers encode alike alone and in place, and their encoding, once for each distinct unit.

A text is cut before each single space that stands between two characters which are no white space. The byte-level
split of words makes a cut there whatever stands around it, and no piece of the sentencepiece vocabulary holds a
space after another character, so ids of the units put in a row are the ids of the text.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White-space bytes of ASCII, some control characters that only some libraries count among them included.
_ASCII_BLANK = np.zeros(256, bool)
_ASCII_BLANK[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
#: First bytes in UTF-8 of all other white space (and of characters that some Unicode versions count as such).
_BLANK_LEADS = np.zeros(256, bool)
_BLANK_LEADS[[0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True
DOUBTFUL = "\u180e\u200b\ufeff"
#: Bytes of clean units that are encoded in one call.
CALL_BYTES = 1 << 19


def blank(c: str) -> bool:
    return c.isspace() or c in DOUBTFUL


def blank_ends(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Whether each string begins and ends with white space; an empty one does both."""
    offsets = np.asarray(pa.Array.from_buffers(pa.int32(), len(strings) + 1, [None, strings.buffers()[1]], offset=strings.offset), np.int64)
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)
    left = np.ones(len(strings), bool)
    right = np.ones(len(strings), bool)
    full = np.flatnonzero(np.diff(offsets))
    if not len(full):
        return left, right
    begin, end = offsets[full], offsets[full + 1]
    head, tail = data[begin], data[end - 1]
    left[full], right[full] = _ASCII_BLANK[head], _ASCII_BLANK[tail]
    for i in full[_BLANK_LEADS[head]].tolist():
        left[i] = blank(strings[i].as_py()[0])
    wide = (tail >= 0x80) & ((data[np.maximum(end - 2, 0)] == 0xC2) | _BLANK_LEADS[data[np.maximum(end - 3, 0)]])
    for i in full[wide].tolist():
        right[i] = blank(strings[i].as_py()[-1])
    return left, right


@dataclass
class Units:
    """Distinct units and the units of each text: ``codes[starts[i]:starts[i + 1]]`` of text ``i``.

    ``strings`` from ``plain`` on are units that begin a text (no space stands before them, one does before all
    others). ``clean`` marks those that may stand beside any other clean one, ``used`` those that occur.
    """

    strings: list[str]
    plain: int
    clean: np.ndarray
    used: np.ndarray
    codes: np.ndarray
    starts: np.ndarray


def cut(texts: pa.Array, own_first: bool = True) -> Units:
    """Units of each text without their space; a null text has none, an empty one the empty unit.

    With ``own_first`` the unit that begins a text is told apart, as no space stands before it.
    """
    parts = pc.split_pattern(texts, " ")
    offsets = np.asarray(parts.offsets, np.int64)
    starts = offsets - offsets[0]
    coded = parts.flatten().dictionary_encode()
    strings = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    n = len(codes)
    bad_left, bad_right = blank_ends(coded.dictionary)
    begins = np.zeros(n, bool)
    begins[starts[:-1][np.diff(starts) > 0]] = True
    cuts = begins.copy()
    if n:
        cuts[1:] |= ~(bad_right[codes[:-1]] | bad_left[codes[1:]])
    at = np.flatnonzero(cuts)
    to = np.r_[at[1:], n] if n else at
    of_unit = codes[at].astype(np.int64)
    known: dict[str, int] = {}
    left, right = [], []
    for u in np.flatnonzero(to - at > 1).tolist():
        own = codes[at[u] : to[u]].tolist()
        s = " ".join([strings[c] for c in own])
        c = known.get(s)
        if c is None:
            c = known[s] = len(coded.dictionary) + len(known)
            left.append(bad_left[own[0]])
            right.append(bad_right[own[-1]])
        of_unit[u] = c
    strings += known
    clean = ~(np.r_[bad_left, np.array(left, bool)] | np.r_[bad_right, np.array(right, bool)])
    plain = len(strings)
    if own_first and n:
        lone = begins[at]
        firsts, back = np.unique(of_unit[lone], return_inverse=True)
        of_unit[lone] = plain + back
        strings += [strings[c] for c in firsts.tolist()]
        clean = np.r_[clean, np.zeros(len(firsts), bool)]
    used = np.bincount(of_unit, minlength=len(strings)) > 0
    return Units(strings, plain, clean, used, of_unit, np.r_[0, np.cumsum(cuts)][starts] if n else np.zeros(len(starts), np.int64))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the runs that begin at ``starts`` and have ``lengths``, one run after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class ByteBpe:
    """A byte-level vocabulary given as ranks, and the pattern that cuts text into words."""

    def __init__(self, path: str, special: dict[str, int]):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.special = special
        self.coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.bytes = [b""] * (1 + max([*ranks.values(), *special.values()]))
        for token, rank in ranks.items():
            self.bytes[rank] = token
        for token, rank in special.items():
            self.bytes[rank] = token.encode()
        self.length = np.array([len(b) for b in self.bytes], np.int64)

    def encode(self, strings: list[str], clean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all strings in a row and the number of ids of each; clean ones begin with a space and are encoded together."""
        array = pa.array(strings, pa.string())
        clean = clean.copy()
        for token in self.special:
            clean &= ~np.asarray(pc.match_substring(array, token))
        sizes = np.asarray(pc.binary_length(array), np.int64)
        ids: list[np.ndarray] = []
        counts = np.zeros(len(strings), np.int64)
        together = np.flatnonzero(clean)
        order = [together]
        call = np.cumsum(sizes[together]) // CALL_BYTES
        for g in np.split(together, np.flatnonzero(np.diff(call)) + 1) if len(together) else []:
            found = np.array(self.coder.encode_ordinary("".join([strings[i] for i in g.tolist()])), np.uint32)
            counts[g] = np.diff(np.searchsorted(np.cumsum(self.length[found]), np.cumsum(sizes[g]), "right"), prepend=0)
            ids.append(found)
        for i in np.flatnonzero(~clean).tolist():
            found = np.array(self.coder.encode(strings[i], allowed_special="all"), np.uint32)
            counts[i] = len(found)
            ids.append(found)
            order.append(np.array([i]))
        flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
        # ``flat`` has the clean strings first: bring the runs into the order of the strings.
        order = np.concatenate(order)
        place = np.empty(len(strings), np.int64)
        place[order] = np.cumsum(counts[order]) - counts[order]
        return flat[ragged(place, counts)], counts


@lru_cache(maxsize=4)
def byte_bpe(path: str, special: tuple[tuple[str, int], ...] = ()) -> ByteBpe:
    return ByteBpe(path, dict(special))


class Pieces:
    """A sentencepiece vocabulary: pieces as bytes, U+2581 as a space and ``<0xHH>`` as a byte."""

    def __init__(self, path: str):
        import sentencepiece

        self.coder = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.coder.id_to_piece(i) for i in range(self.coder.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.coder.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        if any("▁" in p.lstrip("▁") for p in names):
            raise ValueError("a piece holds a space after another character, so words can't be encoded one by one")

    def encode(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all strings, each with the space that the library adds, and the number of ids of each."""
        found = self.coder.encode(strings, num_threads=1) if strings else []
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum())), counts


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    return Pieces(path)
