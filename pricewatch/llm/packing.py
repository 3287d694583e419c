"""Packing tokenised documents into fixed sequences by cutting-stock column generation.

A document is its ids and one end id; it is cut every ``capacity`` tokens, so only its last piece
is shorter. Piece lengths are counted in classes of ``unit`` tokens (rounded up), and the histogram
of classes, not the pieces, is what the linear program sees: minimise the number of sequences over
patterns (how many pieces of each class share one), starting from patterns of one class. A knapsack
dynamic program over the capacity prices the best new pattern from the duals; the program ends
when Farley's bound shows the optimum is within ``gap``. Pattern counts are rounded down, and the
few pieces that remain are placed first-fit by decreasing class. Pieces ranked in their class are
dealt to the patterns' sequences; offsets are sums of true lengths.

Only the histogram (``capacity / unit`` numbers) reaches the driver; ranks come from a range sort,
so a length that a third of all documents share spreads over tasks.

Null text counts as empty (one piece: the end id). Repeated rows and ties are pieces of their own;
texts of any length are encoded whole; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricewatch.llm.common import WordCache, byte_lengths, flat_bytes, ranked, release_memory, slices, stored, tokenizer_file

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


#: Encoded words kept by a task, in each of two generations.
CACHED_WORDS = 150_000
_TOKENIZERS: dict[str, object] = {}
# ASCII punctuation: where it follows an ASCII letter or digit, the tokenizer always cuts.
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SOLID = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz0123456789"))
# Lower-case Latin letters: normalising changes none of them and no rule cuts between them.
_LETTERS = re.compile("[a-zß-öø-ÿ]+")


def _byte_signs() -> list[str]:
    """Sign of each byte in byte-level vocabularies: visible Latin-1 is itself, the rest follows from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(rest)) for b in range(256)]


_SIGNS = str.maketrans({chr(b): sign for b, sign in enumerate(_byte_signs())})


def _tokenizer(path: str):
    """The tokenizer, read once per process."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


def _cache(path: str) -> WordCache:
    """Encoded words: ids as little-endian 32-bit integers."""
    tokenizer = _tokenizer(path)

    def encode(words: list[bytes]) -> list[bytes]:
        texts = [w.decode() for w in words]
        letters = [_LETTERS.fullmatch(t) is not None for t in texts]
        others = [t for t, simple in zip(texts, letters) if not simple]
        whole = iter(tokenizer.encode_batch_fast(others, add_special_tokens=False))
        merged = tokenizer.model.tokenize
        return [
            array("I", [t.id for t in merged(word.decode("latin-1").translate(_SIGNS))] if simple else next(whole).ids).tobytes()
            for word, simple in zip(words, letters)
        ]

    return WordCache(encode, words=CACHED_WORDS)


def _parts(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words as the tokenizer's lower-casing leaves them, cut before their last punctuation where that is
    safe, and how many parts each became.

    Words that may hold a marker of the vocabulary (``<|``) stay as they are.
    """
    marked = pc.match_substring(words, "<|")
    low = pc.if_else(marked, words, pc.ascii_lower(words))
    core = pc.if_else(marked, words, pc.ascii_rtrim(low, _PUNCTUATION))
    size, solid = byte_lengths(core), np.zeros(len(words), dtype=bool)
    flat, ends = flat_bytes(core)
    some = size > 0
    solid[some] = _SOLID[flat[ends[1:][some] - 1]]
    core = pc.if_else(pa.array(solid), core, low)
    cut = np.flatnonzero(byte_lengths(core) < byte_lengths(low))
    long = low.take(pa.array(cut))
    size = byte_lengths(long) - byte_lengths(core.take(pa.array(cut)))
    flat, ends = flat_bytes(long)
    data = flat[np.arange(int(size.sum())) + np.repeat(ends[1:] - np.cumsum(size), size)]
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    tails = pa.Array.from_buffers(pa.string(), len(cut), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    each = np.ones(len(words), dtype=np.int64)
    each[cut] = 2
    order = np.argsort(np.concatenate([np.arange(len(words)), cut + 0.5]), kind="stable")
    return pa.concat_arrays([core, tails]).take(pa.array(order)), each


def _encoded(texts: pa.Array, cache: WordCache) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts one after another, and the number of ids of each text.

    The vocabulary drops white space, so words between ASCII spaces encode alone. Only the distinct
    words of the texts are touched one by one; the ids of all words are gathered at once.
    """
    words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    parts, each = _parts(words.flatten())
    row = np.repeat(row, each)
    coded = parts.cast(pa.binary()).dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    found = cache.look_up(distinct)
    ids = [found[w] for w in distinct]
    size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
    start = np.cumsum(size) - size
    known = np.frombuffer(b"".join(ids), dtype="<u4")
    which = coded.indices.to_numpy(zero_copy_only=False)
    n = size[which]
    place = np.arange(int(n.sum())) + np.repeat(start[which] - (np.cumsum(n) - n), n)
    return known[place], np.bincount(row, n, len(texts)).astype(np.int64)


def _tokenise_batches(path: str, capacity: int, end_id: int):
    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache(path)
        end = np.array([end_id], dtype="<u4").tobytes()
        try:
            for batch in batches:
                for part in slices(batch, "text"):
                    ids, sizes = _encoded(part.column("text"), cache)
                    rows, at = [], 0
                    for doc, n in zip(part.column("doc_id").to_pylist(), sizes.tolist()):
                        own = ids[at : at + n].tobytes() + end
                        at += n
                        for start in range(0, n + 1, capacity):
                            piece = own[4 * start : 4 * (start + capacity)]
                            rows.append((doc, start, len(piece) // 4, zlib.crc32(piece), n + 1))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64()) for c in zip(*rows)],
                        names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                    )
        finally:
            del cache
            release_memory()

    return tokenise


def pieces(
    docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece of every document: start, length, crc32 of its ids, tokens of the document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_tokenise_batches(path, capacity, end_id), _PIECE)


def best_pattern(value: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the pattern of greatest value that fits, by dynamic programming."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fits = sizes <= room
        gain = np.where(fits, best[np.where(fits, room - sizes, 0)] + value, -np.inf)
        k = int(gain.argmax())
        best[room], taken[room] = best[room - 1], -1
        if gain[k] > best[room] + 1e-12:
            best[room], taken[room] = gain[k], k
    pattern, room = np.zeros(len(sizes), dtype=np.int64), capacity
    while room > 0:
        if taken[room] < 0:
            room -= 1
        else:
            pattern[taken[room]] += 1
            room -= sizes[taken[room]]
    return float(best[capacity]), pattern


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 0.001) -> tuple[np.ndarray, np.ndarray]:
    """(patterns as columns, how often each is used) of the linear program, within ``gap``."""
    m = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(columns))
    for step in range(1, 50 * m + 1):
        use = np.maximum(inverse @ demand, 0)
        duals = inverse.sum(axis=0)
        worth, pattern = best_pattern(duals, sizes, capacity)
        if worth <= 1 + gap:  # the optimum is at least use.sum() / worth
            break
        change = inverse @ pattern
        ratio = np.where(change > 1e-9, use / np.where(change > 1e-9, change, 1), np.inf)
        leaves = int(ratio.argmin())
        columns[:, leaves] = pattern
        if step % 100 == 0:
            inverse = np.linalg.inv(columns)
            continue
        row = inverse[leaves] / change[leaves]
        inverse = inverse - np.outer(change, row)
        inverse[leaves] = row
    else:
        raise RuntimeError(f"the linear program is still {worth - 1:.4f} from its optimum after {step} columns")
    return columns.astype(np.int64), np.linalg.solve(columns, demand)


def first_fit(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Patterns, each used once, that hold the demand; largest pieces first."""
    bins: list[np.ndarray] = []
    room: list[int] = []
    for k in np.argsort(-sizes):
        at = 0
        for _ in range(int(demand[k])):
            while at < len(bins) and room[at] < sizes[k]:
                at += 1
            if at == len(bins):
                bins.append(np.zeros(len(sizes), dtype=np.int64))
                room.append(capacity)
            bins[at][k] += 1
            room[at] -= sizes[k]
    return bins


def plan(histogram: dict[int, int], capacity: int, gap: float = 0.001) -> list[tuple[dict[int, int], int]]:
    """(pieces per class, number of sequences) of every pattern; covers the histogram exactly."""
    if not histogram:
        return []
    sizes = np.array(sorted(histogram))
    demand = np.array([histogram[s] for s in sizes.tolist()])
    columns, use = solve(sizes, demand, capacity, gap)
    times = np.floor(np.maximum(use, 0) + 1e-6).astype(np.int64)
    for k in np.argsort(-times):  # rounding noise must not place more pieces than there are
        while times[k] and (columns @ times > demand).any() and (columns[:, k][columns @ times > demand] > 0).any():
            times[k] -= 1
    rest = demand - columns @ times
    patterns = [(columns[:, k], int(n)) for k, n in enumerate(times) if n]
    patterns += [(p, 1) for p in first_fit(sizes, rest, capacity)]
    return [({int(s): int(a) for s, a in zip(sizes, p) if a}, n) for p, n in patterns]


def _runs(patterns: list[tuple[dict[int, int], int]], classes: list[int]) -> tuple[np.ndarray, ...]:
    """Runs of ranks in (class, rank) order: first place, first sequence, pieces per sequence."""
    by_class: dict[int, list[tuple[int, int, int]]] = {c: [] for c in classes}
    base = 0
    for pattern, n in patterns:
        for c, a in pattern.items():
            by_class[c].append((a * n, base, a))
        base += n
    first, at, class_first = [], 0, []
    for c in classes:
        class_first.append(at)
        for n, sequence, a in by_class[c]:
            first.append((at, sequence, a))
            at += n
    runs = np.array(first, dtype=np.int64).reshape(-1, 3)
    return np.array(class_first, dtype=np.int64), runs[:, 0], runs[:, 1], runs[:, 2]


def pack(
    docs: DataFrame, capacity: int = 4096, unit: int = 16, gap: float = 0.001, end_id: int = 2,
    tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Pieces with their sequence and their offset in it."""
    path = tokenizer_path or tokenizer_file("word_bpe_49k.json")
    cut = stored(pieces(docs, path, capacity, end_id, id_col, text_col), "pieces")
    cut = cut.withColumn("_class", F.ceil(F.col("length") / unit).cast("int"))
    numbered, counts = ranked(cut, ["_class"], ["doc_id", "start", "ids_crc32"], "_rank")
    histogram = {r["_class"]: r["n"] for r in counts.collect()}  # at most capacity / unit rows
    classes = sorted(histogram)
    class_first, run_first, run_sequence, run_pieces = _runs(plan(histogram, capacity // unit, gap), classes)

    @F.pandas_udf("long")
    def sequence_of(length_class: pd.Series, rank: pd.Series) -> pd.Series:
        place = class_first[np.searchsorted(classes, length_class.to_numpy())] + rank.to_numpy()
        run = np.searchsorted(run_first, place, side="right") - 1
        return pd.Series(run_sequence[run] + (place - run_first[run]) // run_pieces[run])

    dealt = numbered.withColumn("sequence_id", sequence_of("_class", "_rank"))
    ahead = Window.partitionBy("sequence_id").orderBy(F.desc("_class"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(ahead), F.lit(0)).alias("offset"),
    )
