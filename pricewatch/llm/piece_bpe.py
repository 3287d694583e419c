"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The model file gives pieces and scores. Text becomes symbols (one per code point, spaces as the
space mark, one mark in front); pieces hold the mark only at their start, so no merge crosses from
another character to a mark and the text falls into words that are encoded alone.

Distinct words of a batch are encoded together in flat numpy arrays. Each round looks up the rank
of every adjacent pair, takes the minimum per word, merges its leftmost place in all words at
once, and compacts the arrays; words without a pair drop out. All places of the best pair in a word
are merged in one round when no new pair ranks as high, which gives the same result. A symbol that
is no piece falls back to its UTF-8 bytes.

Null text counts as empty: no ids, empty decoded text. Very long words are encoded whole; only
short words enter the bounded cache of a task. Repeated rows give repeated results, an empty table
an empty one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewatch.llm.common import WordCache, tokenizer_file

MARK = "▁"
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_NO_RANK = np.iinfo(np.int64).max


class PieceModel:
    """Pieces of a model file and the merge table built from them."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        normal = [
            i for i in range(size)
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        ]
        self.text_of = {i: self.pieces[i] for i in normal}
        if any(MARK in p.lstrip(MARK) for p in self.text_of.values()):
            raise ValueError("a piece holds a space mark after another character")
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no byte fallback")
        self.symbol = {p: i for i, p in self.text_of.items()}
        scores = np.array([model.get_score(i) for i in normal])
        rank = dict(zip(normal, np.unique(-scores, return_inverse=True)[1].tolist()))  # equal scores, equal rank
        ids = dict(self.symbol)
        for piece in self.symbol:  # characters that occur only inside longer pieces
            for char in piece:
                ids.setdefault(char, size + len(ids))
        self.char_ids = {c: i for c, i in ids.items() if len(c) == 1}
        self.first_free = max(ids.values()) + 1
        pairs = {}
        for piece, merged in self.symbol.items():
            for cut in range(1, len(piece)):
                left, right = ids.get(piece[:cut]), ids.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[(left << 32) | right] = (rank[merged], merged)
        self.pairs = pairs
        ranks, uses = np.unique(list(rank.values()), return_counts=True)
        self.tied_rank = int(ranks[-1]) if uses[-1] > 1 else -1  # only the last rank may be shared
        if (uses[:-1] > 1).any():
            raise ValueError("pieces share a rank that is not the last")
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_rank = np.array([pairs[k][0] for k in self.pair_keys.tolist()], dtype=np.int64)
        self.pair_piece = np.array([pairs[k][1] for k in self.pair_keys.tolist()], dtype=np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of each pair; the highest rank where it is no piece."""
        keys = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        known = self.pair_keys[at] == keys
        return np.where(known, self.pair_rank[at], _NO_RANK), self.pair_piece[at]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of every word, all words merged together."""
        unknown: dict[str, int] = {}
        known = self.char_ids
        flat = [
            known[c] if c in known else unknown.setdefault(c, self.first_free + len(unknown))
            for w in words for c in w
        ]
        symbols = np.array(flat, dtype=np.int64)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done_symbols, done_words = [], []
        while len(symbols):
            rank, piece = self.ranks(symbols[:-1], symbols[1:])
            rank[word[:-1] != word[1:]] = _NO_RANK
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            rank = np.append(rank, _NO_RANK)  # one entry per symbol: the pair it begins
            best = np.minimum.reduceat(rank, starts)
            count = np.diff(np.append(starts, len(symbols)))
            best_of = np.repeat(best, count)
            active = best_of != _NO_RANK
            if not active.all():
                done_symbols.append(symbols[~active])
                done_words.append(word[~active])
                symbols, word, rank = symbols[active], word[active], rank[active]
                piece, best_of = np.append(piece, 0)[active], best_of[active]
            if not len(symbols):
                break
            if (best_of == self.tied_rank).any():
                symbols, word = self._scan_ties(symbols, word, best_of)
                continue
            merge = self._chosen(symbols, word, rank, best_of, piece)
            symbols = symbols.copy()
            symbols[merge] = piece[merge]
            keep = np.ones(len(symbols), dtype=bool)
            keep[merge + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done_symbols:
            return [[] for _ in words]
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        symbols = symbols[order].tolist()
        ends = np.cumsum(np.bincount(word, minlength=len(words))).tolist()
        back = {i: c for c, i in unknown.items()} | {i: c for c, i in known.items() if i not in self.text_of}
        out, first = [], 0
        for end in ends:
            ids = []
            for s in symbols[first:end]:
                if s in back:
                    ids.extend(self.byte_ids[b] for b in back[s].encode())
                else:
                    ids.append(s)
            out.append(ids)
            first = end
        return out

    def _scan_ties(
        self, symbols: np.ndarray, word: np.ndarray, best_of: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Words whose best pairs all share the one rank of several pieces: merge from the left.

        The leftmost pair goes first, so one scan that steps back after a merge does the rounds of
        a long run of spaces in linear time. It stops where a merge creates a pair of a better rank.
        """
        out_symbols, out_words = [], []
        cuts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]).tolist() + [len(word)]
        for first, end in zip(cuts, cuts[1:]):
            row = symbols[first:end].tolist()
            if best_of[first] == self.tied_rank:
                left, rest = [], row[::-1]
                while rest:
                    rank, merged = self.pairs.get((left[-1] << 32) | rest[-1], (_NO_RANK, 0)) if left else (_NO_RANK, 0)
                    if rank < self.tied_rank:
                        break
                    if rank == self.tied_rank:
                        left.pop()
                        rest[-1] = merged
                    else:
                        left.append(rest.pop())
                row = left + rest[::-1]
            out_symbols.append(np.array(row, dtype=np.int64))
            out_words.append(np.full(len(row), word[first]))
        return np.concatenate(out_symbols), np.concatenate(out_words)

    def _chosen(
        self, symbols: np.ndarray, word: np.ndarray, rank: np.ndarray, best_of: np.ndarray, piece: np.ndarray
    ) -> np.ndarray:
        """Places merged this round: the leftmost best pair of each word, or all its best pairs."""
        at = np.flatnonzero(rank == best_of)
        owner = word[at]
        # places of a run (aaa) overlap: keep every second one from the run's start
        run_start = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (owner[1:] != owner[:-1])])
        run = np.repeat(np.arange(len(run_start)), np.diff(np.append(run_start, len(at))))
        at = at[(np.arange(len(at)) - run_start[run]) % 2 == 0]
        owner = word[at]
        merged = piece[at]
        # a pair that a merge creates must rank lower, else the leftmost place alone is merged
        before, after = at - 1, at + 2
        inside = lambda i: (i >= 0) & (i < len(symbols)) & (word[np.clip(i, 0, len(symbols) - 1)] == owner)
        unsafe = np.zeros(len(at), dtype=bool)
        left, right = inside(before), inside(after)
        prior = symbols[np.clip(before, 0, None)]
        nxt = symbols[np.clip(after, None, len(symbols) - 1)]
        unsafe |= left & (self.ranks(prior, merged)[0] <= best_of[at])
        unsafe |= right & (self.ranks(merged, nxt)[0] <= best_of[at])
        touching = np.r_[(at[1:] == at[:-1] + 2) & (owner[1:] == owner[:-1]), False]
        unsafe |= touching & (self.ranks(merged, np.r_[merged[1:], merged[-1:]])[0] <= best_of[at])
        bad_words = np.unique(owner[unsafe])
        first = np.r_[True, owner[1:] != owner[:-1]]
        return at[first | ~np.isin(owner, bad_words)]

    def plain(self, ids: list[int]) -> str:
        """Text of the ids with spaces for marks; ill-formed bytes become replacement characters."""
        parts, pending = [], bytearray()
        for i in ids:
            if i in self.bytes_of:
                pending.append(self.bytes_of[i])
                continue
            if pending:
                parts.append(_text(bytes(pending)))
                pending = bytearray()
            parts.append(self.text_of.get(i, ""))
        parts.append(_text(bytes(pending)))
        return "".join(parts).replace(MARK, " ")

    def decode(self, ids: list[int]) -> str:
        """As ``plain``, without the space that encoding puts in front."""
        text = self.plain(ids)
        return text[1:] if text.startswith(" ") else text


def _text(data: bytes) -> str:
    """UTF-8 text; a byte that begins no character gives one replacement character."""
    parts = []
    while data:
        try:
            parts.append(data.decode())
            break
        except UnicodeDecodeError as error:
            parts.append(data[: error.start].decode() + "\ufffd")
            data = data[error.start + 1 :]
    return "".join(parts)


def words_of(text: str) -> list[str]:
    return _WORD.findall(MARK + text.replace(" ", MARK)) if text else []


_LOADED: dict[str, PieceModel] = {}


def load(path: str) -> PieceModel:
    """The model, read once per process."""
    if path not in _LOADED:
        _LOADED[path] = PieceModel(path)
    return _LOADED[path]


_CACHES: dict[str, WordCache] = {}


def _cache(path: str) -> WordCache:
    """Encoded words of a process: (number of ids, ids as text, decoded text)."""
    if path not in _CACHES:
        model = load(path)
        _CACHES[path] = WordCache(
            lambda words: [
                (len(ids), ",".join(map(str, ids)), model.plain(ids)) for ids in model.encode_words(words)
            ]
        )
    return _CACHES[path]


def _encode_batches(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache(path)
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                texts = [words_of(t or "") for t in part.column("text").to_pylist()]
                found = cache.look_up(set().union(*texts))
                counts, ids_sha, text_sha = [], [], []
                for words in texts:
                    entries = [found[w] for w in words]
                    counts.append(sum([e[0] for e in entries]))
                    ids_sha.append(hashlib.sha256(",".join([e[1] for e in entries]).encode()).hexdigest())
                    decoded = "".join([e[2] for e in entries])
                    text_sha.append(hashlib.sha256(decoded[1:].encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()),
                     pa.array(text_sha, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return encode


def encode_digests(
    docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Number of ids and digests of the ids and of the decoded text of every row."""
    path = model_path or tokenizer_file("piece_bpe_32k.model")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )
    return rows.mapInArrow(
        _encode_batches(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def encode(texts: list[str], model_path: str | None = None) -> list[list[int]]:
    """Ids of a bounded list of texts, for callers outside Spark and for tests."""
    model = load(model_path or tokenizer_file("piece_bpe_32k.model"))
    words = [words_of(t) for t in texts]
    ids = iter(model.encode_words([w for ws in words for w in ws]))
    return [[i for _ in ws for i in next(ids)] for ws in words]
