"""Spelling variants by a frequency-vector trie.

Words are arranged in a trie by successive letter-group counts: level i branches on how many letters
of group i a word has. One inserted, deleted or replaced letter moves at most one count up and one
down, so a depth-first search spends a budget of one surplus and one deficit; words of the leaves it
reaches are verified letter by letter. The deficit is spent before the surplus, so each pair is
found from one side: the longer word of an insertion, or the word whose earlier differing count is
the larger one; a pair with equal counts is taken from its earlier row.

Letter groups are balanced by the letters of the words at hand. On Spark the trie is cut into
cells, nodes that few enough words visit; a node visited by more is opened one level further, so
cells are small whatever the words look like. Node names are linear in the counts: a search walks
the top of the trie without seeing it and travels once to every cell within its budget. A leaf that
still has too many visitors is cut by the words' first and last three letters, one of which a single
change leaves alone. Inside a cell the search runs on numpy blocks, deepest block first, so memory
does not depend on how many branches it follows. Near words never become rows of pairs: a cell
returns, for each of its words, the count and the best near word.

A null text has no words. A null id counts as empty text in the hash that deletes letters. Repeated
rows count again; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewatch.llm.common import flat_bytes, stored

#: Letter groups, the levels of the trie.
GROUPS = 12
#: Levels at which nodes may become cells.
DEPTHS = (2, 3, 4, 5, 6, 8, 10, GROUPS)
#: Visits beyond which a node is opened.
MOST_VISITS = 200_000
#: Text bytes, search branches and candidate pairs handled at once.
_BYTES, _BRANCHES, _PAIRS = 1 << 22, 1 << 18, 1 << 18
#: A node of this many words or fewer is verified without descending further.
_FEW = 3
#: Letters compared as a block; longer words are compared one by one.
_WIDE = 24
_ENDS = 3

_rng = np.random.default_rng(13)
#: Share of each level in a node's name, and of each depth.
_STEP = _rng.integers(-(1 << 62), 1 << 62, GROUPS)
_DEPTH = {d: int(_rng.integers(-(1 << 62), 1 << 62)) for d in (0, *DEPTHS, GROUPS + 1)}


def _letters() -> np.ndarray:
    """Latin-1 byte to lower-cased letter (only A-Z change), 0 for all that is no letter."""
    table = np.zeros(256, dtype=np.uint8)
    for c in range(256):
        if ord("A") <= c <= ord("Z"):
            table[c] = c + 32
        elif ord("a") <= c <= ord("z") or c >= 0xC0:
            table[c] = c
    return table


_LETTER = _letters()
_CRC = np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], dtype=np.uint32)


def _crc_step(crc: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return _CRC[(crc ^ byte) & 0xFF] ^ (crc >> np.uint32(8))


def _latin(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 to one byte per letter, 0 elsewhere; ``ends`` are moved along."""
    lead = flat == 0xC3
    letter = np.where(flat < 0x80, _LETTER[flat], 0).astype(np.uint8)
    tail = np.flatnonzero(lead[:-1]) + 1 if len(flat) else np.zeros(0, np.int64)
    letter[tail] = flat[tail] | 0x40
    before = np.concatenate(([0], np.cumsum(~lead)))
    return letter[~lead], before[ends]


def _words_of(letter: np.ndarray, ends: np.ndarray, seeds: np.ndarray, shortest: int, one_in: int) -> pa.Array:
    """Words of the rows that end at ``ends``, with the letters deleted that their hash tells."""
    inside = np.concatenate(([False], letter != 0, [False]))
    opens, closes = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cuts = ends[(ends > 0) & (ends < len(letter))]
    opens[cuts] = letter[cuts] != 0
    closes[cuts - 1] = letter[cuts - 1] != 0
    start, stop = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    long = stop - start >= shortest
    start, stop = start[long], stop[long]
    size = stop - start
    order = np.argsort(-size, kind="stable")  # those still running come first
    start, stop, size = start[order], stop[order], size[order]
    crc = ~seeds[np.searchsorted(ends, start, side="right")]
    running = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), side="left")
    for k, n in enumerate(running.tolist()):
        byte = letter[start[:n] + k].astype(np.uint32)
        wide = byte >= 0x80
        crc[:n] = _crc_step(crc[:n], np.where(wide, np.uint32(0xC3), byte))
        if wide.any():
            at = np.flatnonzero(wide)
            crc[at] = _crc_step(crc[at], byte[at] & ~np.uint32(0x40))
    crc = ~crc
    hit = np.flatnonzero(crc % one_in == 0)
    kept = np.zeros(len(letter) + 1, dtype=np.int8)
    kept[start] += 1
    np.subtract.at(kept, stop, 1)
    kept = np.cumsum(kept[:-1], dtype=np.int8)
    kept[start[hit] + crc[hit] % size[hit]] = 0
    by_place = np.argsort(start)
    size[hit] -= 1
    size = size[by_place]
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    words = pa.Array.from_buffers(
        pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(letter[kept == 1])]
    )
    return words.filter(pa.array(size >= shortest))


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(letters, row ends, row seeds) of about ``_BYTES`` bytes, cut between rows or words."""
    column = batch.column("text")
    ids = batch.column("doc_id").to_pylist()
    seeds = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], dtype=np.uint32)
    flat, offsets = flat_bytes(column)
    at = 0
    while at < len(flat):
        to = min(at + _BYTES, len(flat))
        while to < len(flat) and (flat[to] >= 0x80 or _LETTER[flat[to]]):
            to += 1
        first, last = np.searchsorted(offsets, (at, to), side="right")
        ends = np.minimum(offsets[first : max(last, first) + 1], to) - at
        yield *_latin(flat[at:to], ends), seeds[first - 1 : first - 1 + len(ends)]
        at = to


def counts(
    docs: DataFrame, shortest: int = 7, one_in: int = 31, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """raw (Latin-1 bytes of the word), n: all words of at least ``shortest`` letters after deletion."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table] = []
        rows = 0

        def merged() -> pa.Table:
            table = pa.concat_tables(kept).group_by("raw").aggregate([("n", "sum")])
            return table.select(["raw", "n_sum"]).rename_columns(["raw", "n"])

        for batch in batches:
            for block in _blocks(batch):
                found = _words_of(*block, shortest, one_in).value_counts()
                kept.append(pa.table({"raw": found.field("values"), "n": found.field("counts")}))
                rows += len(found)
                if rows > 1 << 19:
                    one = merged()
                    kept, rows = [one], one.num_rows
                    if rows > 1 << 18:
                        yield from one.combine_chunks().to_batches(1 << 16)
                        kept, rows = [], 0
        if kept:
            yield from merged().combine_chunks().to_batches(1 << 16)

    rows = docs.select(
        F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )
    return rows.mapInArrow(run, "raw binary, n long").groupBy("raw").agg(F.sum("n").alias("n"))


def letter_groups(words: DataFrame) -> np.ndarray:
    """Group of every byte: letters by falling frequency, each to the group with the fewest so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(256, dtype=np.int64)
        for batch in batches:
            seen += np.bincount(flat_bytes(batch.column("raw"))[0], minlength=256)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["letter", "n"])

    found = words.select("raw").mapInArrow(run, "letter int, n long").groupBy("letter").agg(F.sum("n").alias("n"))
    load = [0] * GROUPS
    group = np.arange(256) % GROUPS
    for r in sorted(found.collect(), key=lambda r: (-r["n"], r["letter"])):  # at most 90 rows
        least = load.index(min(load))
        group[r["letter"]] = least
        load[least] += r["n"]
    return group


def _vectors(flat: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> np.ndarray:
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    n = (len(offsets) - 1) * GROUPS
    return np.bincount(row * GROUPS + group[flat], minlength=n).reshape(-1, GROUPS).astype(np.int32)


def _ends(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Names of the first and of the last letters of every word: (words, 2)."""
    out = []
    for side, base in ((0, offsets[:-1]), (1, offsets[1:] - _ENDS)):
        name = np.full(len(base), side, dtype=np.int64)
        for k in range(_ENDS):
            name = name << 8 | flat[base + k]
        out.append(name * 0x5851F42D4C957F2D)
    return np.stack(out, axis=1)


def _walk(vectors: np.ndarray, opened: dict[int, np.ndarray], upto: int) -> Iterator[tuple]:
    """(depth, word, node, home) of every node a word's search reaches: cells, or all of depth ``upto``.

    ``opened`` holds the opened nodes of each depth; a search goes on below these only.
    """
    word = np.arange(len(vectors))
    spent = np.zeros(len(vectors), dtype=np.int8)
    node = np.zeros(len(vectors), dtype=np.int64)
    for level in range(GROUPS):
        step = _STEP[level]
        node = node + vectors[word, level] * step
        less = (spent == 0) & (vectors[word, level] > 0)
        more = spent == 1
        word = np.concatenate([word, word[less], word[more]])
        node = np.concatenate([node, node[less] - step, node[more] + step])
        spent = np.concatenate([spent, np.ones(less.sum(), np.int8), np.full(more.sum(), 2, np.int8)])
        depth = level + 1
        if depth in DEPTHS:
            name = node + _DEPTH[depth]
            if depth == upto:
                yield depth, word, name, spent == 0
                return
            on = np.isin(name, opened.get(depth, ()))
            yield depth, word[~on], name[~on], spent[~on] == 0
            word, node, spent = word[on], node[on], spent[on]
    yield GROUPS + 1, word, node, spent == 0  # leaves with too many visitors


def _opened(words: DataFrame, group: np.ndarray, most: int) -> dict[int, np.ndarray]:
    """Nodes with more than ``most`` visits at each depth: at most visits / ``most`` names."""
    opened: dict[int, np.ndarray] = {}
    for depth in DEPTHS:

        def visits(batches: Iterator[pa.RecordBatch], depth: int = depth) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first in range(0, batch.num_rows, 4096):
                    part = batch.slice(first, 4096)
                    vectors = _vectors(*flat_bytes(part.column("raw")), group)
                    found = [name for d, _, name, _ in _walk(vectors, opened, depth) if d == depth]
                    name, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(n)], names=["node", "n"])

        sums = words.select("raw").mapInArrow(visits, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
        hot = [r["node"] for r in sums.where(F.col("n") > most).select("node").collect()]
        if not hot:
            break
        opened[depth] = np.array(sorted(hot), dtype=np.int64)
    return opened


def _travel(opened: dict[int, np.ndarray], group: np.ndarray):
    """Rows (cell, raw, n, home, side): every cell that a word's search visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                part = batch.slice(first, 4096)
                flat, offsets = flat_bytes(part.column("raw"))
                ends = _ends(flat, offsets)
                for depth, word, name, home in _walk(_vectors(flat, offsets, group), opened, 0):
                    side = np.full(len(word), -1, np.int8)
                    if depth > GROUPS:
                        name = np.concatenate([name + ends[word, 0], name + ends[word, 1]])
                        side = np.repeat(np.array([0, 1], np.int8), len(word))
                        word, home = np.tile(word, 2), np.tile(home, 2)
                    at = pa.array(word)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(name), part.column("raw").take(at), part.column("n").take(at), pa.array(home), pa.array(side)],
                        names=["cell", "raw", "n", "home", "side"],
                    )

    return run


class _Trie:
    """Trie over count vectors: children of a level are sorted (parent, count) keys."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.order = np.lexsort(vectors.T[::-1])
        rows = vectors[self.order]
        self.base = int(vectors.max(initial=0)) + 2
        parent = np.zeros(len(rows), dtype=np.int64)
        self.keys, self.first, self.size = [], [np.zeros(1, np.int64)], [np.array([len(rows)])]
        for level in range(vectors.shape[1]):
            keys, first, parent, size = np.unique(
                parent * self.base + rows[:, level], return_index=True, return_inverse=True, return_counts=True
            )
            self.keys.append(keys)
            self.first.append(first)
            self.size.append(size)

    def child(self, level: int, node: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Child of each node with this count, or -1."""
        wanted = node * self.base + count
        keys = self.keys[level]
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        fine = (count >= 0) & (count < self.base) & (keys[at] == wanted)
        return np.where(fine, at, -1)

    def search(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, row of the trie) candidates, in blocks."""
        last = len(self.keys)
        stack = [
            (0, np.arange(a, min(a + _BRANCHES, len(queries))), None, None)
            for a in range(0, len(queries), _BRANCHES)
        ]
        while stack:
            level, query, node, spent = stack.pop()
            if node is None:
                node, spent = np.zeros(len(query), np.int64), np.zeros(len(query), np.int8)
            size = self.size[level][node]
            done = (size <= _FEW) | (level == last)
            if done.any():
                yield from self._leaves(level, query[done], node[done])
                query, node, spent = query[~done], node[~done], spent[~done]
            if not len(query):
                continue
            count = queries[query, level]
            parts = []
            for chosen, change, then in ((slice(None), 0, None), (spent == 0, -1, 1), (spent == 1, 1, 2)):
                q, before = query[chosen], spent[chosen]
                below = self.child(level, node[chosen], count[chosen] + change)
                there = below >= 0
                parts.append((q[there], below[there], before[there] if then is None else np.full(there.sum(), then, np.int8)))
            query, node, spent = (np.concatenate(x) for x in zip(*parts))
            for a in range(0, len(query), _BRANCHES):
                cut = slice(a, a + _BRANCHES)
                stack.append((level + 1, query[cut], node[cut], spent[cut]))

    def _leaves(self, level: int, query: np.ndarray, node: np.ndarray) -> Iterator[tuple]:
        size, first = self.size[level][node], self.first[level][node]
        total = np.cumsum(size)
        at = 0
        while at < len(query):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _PAIRS, side="right")))
            n = size[at:to]
            if to == at + 1 and n[0] > _PAIRS:  # one query, a leaf of very many words
                for a in range(0, int(n[0]), _PAIRS):
                    rows = np.arange(first[at] + a, first[at] + min(a + _PAIRS, int(n[0])))
                    yield np.full(len(rows), query[at]), self.order[rows]
            else:
                rows = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at:to], n)
                yield np.repeat(query[at:to], n), self.order[rows]
            at = to


def near(a: bytes, b: bytes) -> bool:
    """Whether exactly one inserted, deleted or replaced letter tells the words apart."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    return a[k + 1 :] == (b[k + 1 :] if len(a) == len(b) else b[k:])


class _Letters:
    """Words as a block of letters."""

    def __init__(self, raw: pa.Array) -> None:
        self.raw = raw
        flat, offsets = flat_bytes(raw)
        self.size = np.diff(offsets)
        self.block = np.zeros((len(raw), _WIDE + 1), dtype=np.uint8)
        row = np.repeat(np.arange(len(raw)), self.size)
        place = np.arange(len(flat)) - np.repeat(offsets[:-1], self.size)
        fits = place < _WIDE
        self.block[row[fits], place[fits]] = flat[fits]

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs are near; no word of ``a`` is shorter than its partner."""
        gap = self.size[a] - self.size[b]
        fine = (gap == 0) | (gap == 1)
        long = fine & (self.size[a] > _WIDE)
        short = np.flatnonzero(fine & ~long)
        x, y = self.block[a[short]], self.block[b[short]]
        differ = x != y
        k = differ.argmax(axis=1)
        replaced = differ.sum(axis=1) == 1
        later = np.arange(_WIDE)[None, :] >= k[:, None]
        moved = ~((x[:, 1:] != y[:, :-1]) & later).any(axis=1)
        out = np.zeros(len(a), dtype=bool)
        out[short] = np.where(gap[short] == 0, replaced, moved)
        for i in np.flatnonzero(long):
            out[i] = near(self.raw[int(a[i])].as_py(), self.raw[int(b[i])].as_py())
        return out


def _from_this_side(change: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    """Whether the first count that differs is a deficit of the partner; with equal counts, ``earlier``."""
    first = (change != 0).argmax(axis=1)
    lead = change[np.arange(len(change)), first]
    return (lead > 0) | ((lead == 0) & earlier)


_PARTIAL = "raw binary, n_near long, form_n long, form binary"


def _meet(group: np.ndarray):
    """Count and best near word of every word of a cell, from this cell's pairs."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        raw, n = rows.column("raw").chunk(0), rows.column("n").to_numpy()
        side = rows.column("side").to_numpy()
        letters = _Letters(raw)
        flat, offsets = flat_bytes(raw)
        vectors = _vectors(flat, offsets, group)
        at_home = np.flatnonzero(rows.column("home").to_numpy(zero_copy_only=False))
        ends = _ends(flat, offsets) if (side == 1).any() else None
        rank = np.empty(len(raw), np.int64)
        rank[pc.sort_indices(raw).to_numpy()] = np.arange(len(raw))
        best = {}
        owners, others = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        kept = 0

        def folded() -> None:
            """Reduce the pairs so far to one row per word."""
            nonlocal kept
            owner, other = np.concatenate(owners), np.concatenate(others)
            order = np.lexsort((rank[other], -n[other], owner))
            owner, other = owner[order], other[order]
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
            many = np.diff(np.append(first, len(owner)))
            for o, w, c in zip(owner[first].tolist(), other[first].tolist(), many.tolist()):
                had = best.get(o)
                if had is None:
                    best[o] = (w, c)
                else:
                    lead = had[0] if (-n[had[0]], rank[had[0]]) <= (-n[w], rank[w]) else w
                    best[o] = (lead, had[1] + c)
            owners[:], others[:], kept = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

        if len(at_home):
            for query, row in _Trie(vectors[at_home]).search(vectors):
                other = at_home[row]
                keep = letters.size[query] >= letters.size[other]
                query, other = query[keep], other[keep]
                keep = letters.near(query, other)
                query, other = query[keep], other[keep]
                keep = _from_this_side(vectors[query] - vectors[other], query < other)
                if ends is not None:  # met by first letters already
                    keep &= ~((side[query] == 1) & (ends[query, 0] == ends[other, 0]))
                query, other = query[keep], other[keep]
                owners += [query, other]
                others += [other, query]
                kept += 2 * len(query)
                if kept > 1 << 21:
                    folded()
        folded()
        own = pa.array(list(best), pa.int64())
        lead = np.array([w for w, _ in best.values()], dtype=np.int64)
        return pa.table(
            {
                "raw": raw.take(own),
                "n_near": pa.array([c for _, c in best.values()], pa.int64()),
                "form_n": pa.array(n[lead], pa.int64()),
                "form": raw.take(pa.array(lead)),
            }
        )

    return run


def near_words(words: DataFrame, most_visits: int = MOST_VISITS) -> DataFrame:
    """raw, n -> raw, n_near, form_n, form: the near words of each word that has any."""
    group = letter_groups(words)
    opened = _opened(words, group, most_visits)
    visits = words.select("raw", "n").mapInArrow(
        _travel(opened, group), "cell long, raw binary, n long, home boolean, side byte"
    )
    partial = visits.groupBy("cell").applyInArrow(_meet(group), _PARTIAL)
    # a null at the place of the sign: larger counts first, then the smaller word
    return partial.groupBy("raw").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("_m"), F.col("form"))).alias("_best")
    ).select("raw", "n_near", (-F.col("_best._m")).alias("form_n"), F.col("_best.form").alias("form"))


def _rooted(forms: DataFrame) -> DataFrame:
    """raw, form -> raw, root: end of every chain of forms, by doubling.

    A form is ``ratio`` times as frequent as its word, so chains are short and never close.
    """
    links = stored(forms.where(F.col("form").isNotNull()).select("raw", F.col("form").alias("root")), "form-links")
    while True:
        onward = links.select(F.col("raw").alias("_at"), F.col("root").alias("_then"))
        step = links.join(onward, F.col("root") == F.col("_at"), "left")
        step = stored(step.select("raw", F.coalesce("_then", "root").alias("root"), F.col("_at").isNotNull().alias("_moved")), "form-chains")
        links = step.select("raw", "root")
        if step.where("_moved").isEmpty():
            return links


def variants(
    docs: DataFrame, shortest: int = 7, least: int = 2, ratio: int = 10, one_in: int = 31,
    most_visits: int = MOST_VISITS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs``.

    ``form`` is the near word of largest n (ties: the smaller word) if that n is at least ``ratio``
    times the word's own, else null; ``root`` follows forms to the last.
    """
    if ratio <= 1:
        raise ValueError("a form must be more frequent than its word, or forms could go round")
    words = stored(counts(docs, shortest, one_in, id_col, text_col).where(F.col("n") >= least), "words")
    found = words.join(near_words(words, most_visits), "raw", "left")
    taken = F.col("form_n") >= ratio * F.col("n")
    forms = stored(
        found.select(
            "raw", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(taken, F.col("form")).alias("form"), F.when(taken, F.col("form_n")).alias("form_n"),
        ),
        "forms",
    )
    ended = forms.join(_rooted(forms), "raw", "left")
    text = lambda c: F.decode(c, "ISO-8859-1")
    return ended.select(
        text(F.col("raw")).alias("word"), text(F.col("form")).alias("form"),
        text(F.coalesce("root", "raw")).alias("root"), "n", "n_near", "form_n",
    )
