"""Suffix arrays by induced sorting, and permuted common prefixes, for arrays of small numbers."""

from __future__ import annotations

import numpy as np


def _types(text: np.ndarray) -> np.ndarray:
    """True for S-type suffixes: smaller than the next one. The last suffix is S."""
    n = len(text)
    different = text[:-1] != text[1:]
    # Each position takes its answer from the next one where the symbol changes.
    at = np.where(different, np.arange(n - 1), n)
    following = np.minimum.accumulate(at[::-1])[::-1]
    smaller = np.r_[text[:-1] < text[1:], True]
    return np.r_[smaller[np.minimum(following, n - 1)], True]


def _deal(sa: np.ndarray, places: np.ndarray, text: np.ndarray, free: np.ndarray, step: int) -> None:
    """Puts suffixes, in their order, at the next free place of the bucket of their first symbol."""
    symbols = text[places]
    order = np.argsort(symbols, kind="stable")
    places, symbols = places[order], symbols[order]
    counts = np.bincount(symbols, minlength=len(free))
    within = np.arange(len(places)) - np.repeat(np.cumsum(counts) - counts, counts)
    sa[free[symbols] + step * within] = places
    free += step * counts


def _induce(text: np.ndarray, is_s: np.ndarray, sigma: int, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the LMS suffixes in order: a pass up for L-type, one down for S-type.

    A bucket is read as a whole; suffixes that it induces into itself form the next wave.
    """
    ends = np.cumsum(np.bincount(text, minlength=sigma))
    starts = np.r_[0, ends[:-1]]
    sa = np.full(len(text), -1, np.int64)
    tails = ends - 1
    _deal(sa, lms[::-1], text, tails, -1)
    heads = starts.copy()

    def preceding(items: np.ndarray, want_s: bool) -> np.ndarray:
        before = items[items > 0] - 1
        return before[is_s[before] == want_s]

    for c in range(sigma):
        at = starts[c]
        while at < heads[c]:
            wave = sa[at : heads[c]]
            at = heads[c]
            _deal(sa, preceding(wave, False), text, heads, 1)
        if tails[c] + 1 < ends[c]:
            _deal(sa, preceding(sa[tails[c] + 1 : ends[c]], False), text, heads, 1)
    tails = ends - 1
    for c in range(sigma - 1, -1, -1):
        at = ends[c] - 1
        while at > tails[c]:
            wave = sa[tails[c] + 1 : at + 1][::-1]
            at = tails[c]
            _deal(sa, preceding(wave, True), text, tails, -1)
        if heads[c] > starts[c]:
            _deal(sa, preceding(sa[starts[c] : heads[c]][::-1], True), text, tails, -1)
    return sa


def _induce_many(text: list[int], is_s: list[bool], sigma: int, lms: list[int]) -> list[int]:
    """The same for many symbols, suffix by suffix: buckets are too small to be read as a whole."""
    n = len(text)
    counts = [0] * (sigma + 1)
    for c in text:
        counts[c + 1] += 1
    for c in range(sigma):
        counts[c + 1] += counts[c]
    sa = [-1] * n
    tails = counts[1:]
    for p in reversed(lms):
        c = text[p]
        tails[c] -= 1
        sa[tails[c]] = p
    heads = counts[:-1]
    for p in sa:
        if p > 0 and not is_s[p - 1]:
            c = text[p - 1]
            sa[heads[c]] = p - 1
            heads[c] += 1
    tails = counts[1:]
    for i in range(n - 1, -1, -1):
        p = sa[i]
        if p > 0 and is_s[p - 1]:
            c = text[p - 1]
            tails[c] -= 1
            sa[tails[c]] = p - 1
    return sa


#: Texts with more different symbols are induced suffix by suffix.
WIDE = 512


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of ``text`` in order; its last number must be smaller than all others.

    Classify suffixes; sort LMS substrings by induction and name them; sort the LMS suffixes
    recursively by their names unless these are unique; induce the rest.
    """
    n = len(text)
    if n < 3:
        return np.arange(n)[::-1].copy()
    sigma = int(text.max()) + 1
    is_s = _types(text)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    if sigma <= WIDE:
        def induce(order):
            return _induce(text, is_s, sigma, order)
    else:
        as_list, s_list = text.tolist(), is_s.tolist()

        def induce(order):
            return np.array(_induce_many(as_list, s_list, sigma, order.tolist()), np.int64)
    sa = induce(lms)
    mark = np.zeros(n, bool)
    mark[lms] = True
    ordered = sa[mark[sa]]
    names, n_names = _names(text, lms, ordered)
    if n_names < len(lms):
        ordered = lms[suffix_array(names)]
    return induce(ordered)


def _names(text: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings in text order: equal substrings share one; how many there are."""
    length = np.zeros(len(text), np.int64)
    length[lms] = np.diff(np.r_[lms, len(text)])
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    same[0 if len(same) else slice(0)] = False  # the first is the end mark
    active = np.flatnonzero(same)
    offset = 0
    while len(active):
        # A substring ends with the first symbol of the next one.
        equal = text[a[active] + offset] == text[b[active] + offset]
        same[active[~equal]] = False
        active = active[equal]
        offset += 1
        active = active[length[a[active]] >= offset]
    name = np.zeros(len(text), np.int64)
    name[ordered] = np.r_[0, np.cumsum(~same)]
    return name[lms], int(name[ordered[-1]]) + 1


def permuted_lcp(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order, by place in the text.

    Only irreducible places (whose left neighbours differ) are compared, all at once symbol by symbol;
    at any other place the value is one less than at the place before.
    """
    n = len(text)
    phi = np.empty(n, np.int64)
    phi[sa[1:]] = sa[:-1]
    phi[sa[0]] = -1
    at = np.arange(n)
    left = np.r_[-1, text[:-1]]
    irreducible = (phi < 0) | (at == 0) | (phi == 0) | (left != left[np.maximum(phi, 0)])
    plcp = np.zeros(n, np.int64)
    active = np.flatnonzero(irreducible & (phi >= 0))
    offset = 0
    while len(active):
        inside = np.maximum(active, phi[active]) + offset < n
        active = active[inside]
        active = active[text[active + offset] == text[phi[active] + offset]]
        plcp[active] += 1
        offset += 1
    source = np.maximum.accumulate(np.where(irreducible, at, 0))
    return np.maximum(plcp[source] - (at - source), 0)
