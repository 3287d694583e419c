"""Suffix arrays by induced sorting (SA-IS) for many strings at once, and their common prefixes.

The rows of a matrix are independent strings. All steps of induced sorting run over the columns and
handle one place of every row together, so the linear scans cost a few numpy calls per column.
"""

from __future__ import annotations

import numpy as np


def _types(text: np.ndarray) -> np.ndarray:
    """True for S-type suffixes (smaller than the next), False for L-type."""
    rows, n = text.shape
    order = np.sign(text[:, 1:].astype(np.int64) - text[:, :-1])  # 1: smaller than the next
    place = np.where(order != 0, np.arange(n - 1), n - 1)
    following = np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1]
    padded = np.concatenate([order, np.ones((rows, 1), dtype=order.dtype)], axis=1)
    smaller = np.take_along_axis(padded, following, axis=1) > 0
    return np.concatenate([smaller, np.ones((rows, 1), dtype=bool)], axis=1)


def _lms(s_type: np.ndarray) -> np.ndarray:
    """Leftmost S-type places: S-type after an L-type."""
    found = np.zeros_like(s_type)
    found[:, 1:] = s_type[:, 1:] & ~s_type[:, :-1]
    return found


class _Induction:
    """Buckets of a matrix of strings and the two induction scans."""

    def __init__(self, text: np.ndarray, symbols: int) -> None:
        self.rows, self.n = text.shape
        self.symbols = symbols
        self.text = np.ascontiguousarray(text, dtype=np.int32)
        self.s_type = _types(self.text)
        self.lms = _lms(self.s_type)
        self.row = np.arange(self.rows)
        slot = (self.row[:, None] * symbols + self.text).ravel()
        counts = np.bincount(slot, minlength=self.rows * symbols).reshape(self.rows, symbols)
        self.ends = np.cumsum(counts, axis=1)
        self.starts = self.ends - counts

    def sort(self, row: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Suffix array induced from LMS places, given by row and in the order wanted in a bucket."""
        rows, n, symbols = self.rows, self.n, self.symbols
        suffixes = np.full((rows, n), -1, dtype=np.int32)
        bucket = row * symbols + self.text[row, place]
        order = np.argsort(bucket, kind="stable")
        sorted_bucket = bucket[order]
        last = np.flatnonzero(np.r_[sorted_bucket[1:] != sorted_bucket[:-1], True])
        size = np.diff(np.r_[-1, last])
        from_end = np.repeat(last, size) - np.arange(len(order))
        suffixes[row[order], self.ends.ravel()[sorted_bucket] - 1 - from_end] = place[order]
        self._scan(suffixes, self.starts.copy().ravel(), range(n), False)
        self._scan(suffixes, self.ends.copy().ravel(), range(n - 1, -1, -1), True)
        return suffixes

    def _scan(self, suffixes: np.ndarray, next_slot: np.ndarray, columns: range, s_type: bool) -> None:
        flat, text, types = suffixes.ravel(), self.text.ravel(), self.s_type.ravel()
        base, bucket_base, n = self.row * self.n, self.row * self.symbols, self.n
        step = -1 if s_type else 1
        for column in columns:
            before = suffixes[:, column] - 1
            at = np.flatnonzero(before >= 0)
            own = base[at] + before[at]
            chosen = types[own] == s_type
            at, own = at[chosen], own[chosen]
            if not len(at):
                continue
            slot = bucket_base[at] + text[own]
            place = next_slot[slot]
            next_slot[slot] = place + step
            flat[base[at] + (place - 1 if s_type else place)] = own - base[at]
        assert n == suffixes.shape[1]


def _names(text: np.ndarray, lms: np.ndarray, s_type: np.ndarray, row: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Rank of each LMS substring; places come sorted by (row, substring)."""
    n = text.shape[1]
    following = np.where(lms, np.arange(n), n)
    ahead = np.minimum.accumulate(following[:, ::-1], axis=1)[:, ::-1]
    end = np.where(place + 1 < n, ahead[row, np.minimum(place + 1, n - 1)], n)
    length = np.where(place + 1 < n, np.minimum(end, n - 1), n - 1) - place  # up to the next LMS place, included
    new_row = np.r_[True, row[1:] != row[:-1]]
    differs = np.r_[True, length[1:] != length[:-1]] | new_row
    pairs = np.flatnonzero(~differs)
    offset = 0
    while len(pairs):
        here, there = place[pairs] + offset, place[pairs - 1] + offset
        r = row[pairs]
        unequal = (text[r, here] != text[r, there]) | (s_type[r, here] != s_type[r, there])
        differs[pairs[unequal]] = True
        pairs = pairs[~unequal]
        pairs = pairs[length[pairs] > offset]
        offset += 1
    count = np.cumsum(differs)
    first = np.flatnonzero(new_row)
    return count - np.repeat(count[first], np.diff(np.append(first, len(row))))


def suffix_arrays(text: np.ndarray, symbols: int) -> np.ndarray:
    """Suffix array of every row; each row ends with a 0 that occurs nowhere else in it."""
    rows, n = text.shape
    if n == 1:
        return np.zeros((rows, 1), dtype=np.int32)
    induced = _Induction(text, symbols)
    row, place = np.nonzero(induced.lms)
    first = induced.sort(row, place)
    is_lms = np.take_along_axis(induced.lms, first, axis=1)
    row, column = np.nonzero(is_lms)
    place = first[row, column]
    name = _names(induced.text, induced.lms, induced.s_type, row, place)
    counts = np.bincount(row, minlength=rows)
    starts = np.cumsum(counts) - counts
    distinct = np.zeros(rows, dtype=np.int64)
    np.maximum.at(distinct, row, name + 1)
    again = distinct < counts  # rows where substrings repeat: sort them as a shorter string
    if again.any():
        number = np.cumsum(again) - 1
        width = int(counts[again].max()) + 1
        shorter = np.ones((int(again.sum()), width), dtype=np.int32)
        shorter[:, -1] = 0
        chosen = again[row]
        r, p, v = row[chosen], place[chosen], name[chosen]
        order = np.lexsort((p, r))
        r, p, v = r[order], p[order], v[order]
        nth = np.arange(len(r)) - np.repeat(np.flatnonzero(np.r_[True, r[1:] != r[:-1]]), counts[again])
        shorter[number[r], nth] = v + 2
        solved = suffix_arrays(shorter, int(v.max()) + 3)
        text_order = np.zeros(shorter.shape, dtype=np.int64)
        text_order[number[r], nth] = p
        real = solved < counts[again][:, None]
        rr, cc = np.nonzero(real)
        place[np.flatnonzero(chosen)] = text_order[rr, solved[rr, cc]]
        del starts
    return induced.sort(row, place)


def permuted_common_prefixes(text: np.ndarray, suffixes: np.ndarray, enough: int) -> np.ndarray:
    """True where the suffix shares its first ``enough`` symbols with a neighbour in the suffix array.

    The permuted common prefixes are found in text order, where each is at least the last less one,
    so every row takes at most two steps per symbol.
    """
    rows, n = text.shape
    index = np.arange(rows)
    previous = np.full((rows, n), -1, dtype=np.int64)
    np.put_along_axis(previous, suffixes[:, 1:].astype(np.int64), suffixes[:, :-1].astype(np.int64), axis=1)
    shared = np.zeros((rows, n), dtype=np.int32)
    flat, prior = text.ravel(), previous.ravel()
    at, length, base = np.zeros(rows, dtype=np.int64), np.zeros(rows, dtype=np.int64), index * n
    active = index
    while len(active):
        here = at[active]
        other = prior[base[active] + here]
        l = length[active]
        inside = (other >= 0) & (np.maximum(here, other) + l < n)
        same = inside & (
            flat[base[active] + np.minimum(here + l, n - 1)] == flat[base[active] + np.minimum(np.maximum(other, 0) + l, n - 1)]
        )
        grow, stop = active[same], active[~same]
        length[grow] += 1
        shared[stop, at[stop]] = length[stop]
        at[stop] += 1
        length[stop] = np.maximum(length[stop] - 1, 0)
        if len(stop):
            active = active[at[active] < n]
    enough_back = shared >= enough
    found = enough_back.copy()
    r, p = np.nonzero(enough_back)
    found[r, previous[r, p]] = True  # the neighbour before shares the same prefix
    return found
