"""Removal of repeated passages by suffix arrays over content-keyed shards.

A byte goes if it lies in a string of ``length`` bytes that also starts anywhere else in the corpus.

Shards. Every window of ``length`` bytes picks an anchor: of its ``gram``-byte strings the one with
the smallest hash, the leftmost of equals. Equal windows pick equal anchors, so a passage and its
repeat meet under one key. Consecutive windows with one anchor form a snippet. Keys seen once are
dropped on numbers alone; equal snippets are counted, not gathered; what remains, different snippets under one key, is a
shard. A shard's suffix array is built by induced sorting (types, leftmost-smaller substrings sorted
recursively, linear induction; many shards at once), and the permuted common prefixes tell which
starts share ``length`` bytes with another start.

A key with very many different snippets (a passage that a third of all documents quote, each in
other surroundings) would be one huge shard. It is split by content until its strings are equal:
each of its windows is keyed by its own whole content and counted, again on numbers alone.

Runs of repeated starts return to their documents by (id, text hash). Null text counts as empty,
a text shorter than ``length`` loses nothing, repeated rows are repeats of each other, null ids are
told apart by their texts; an empty table gives an empty result. Very long texts are read in
overlapping blocks; no window is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewatch.llm.common import sliced, stored
from pricewatch.llm.suffix_array import permuted_common_prefixes, suffix_arrays

#: Bytes of a text hashed at once; places in a block fit the low bits of a packed hash.
_BLOCK, _PLACE_BITS = 1 << 16, 17
_BASE = 0x9E3779B97F4A7C15 | 1
#: Symbols of a shard: end, filling, separator, then the bytes.
_FILL, _SEPARATOR, _BYTE = 1, 2, 3
#: Symbols in a batch of shards, and different snippets in a shard that is not split. The induction walks a
#: shard's places one after another, for all shards of a batch at once: a symbol costs 2 microseconds in
#: shards of 12 snippets, 4 in shards of 32, 7 in shards of 64 and 21 in shards of 256.
BATCH_SYMBOLS, SHARD_SNIPPETS = 3_000_000, 32

_ANCHORS = "id long, text_hash long, first int, last int, key long, snippet long"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE, dtype=np.uint64)])
    down = np.cumprod(np.r_[np.uint64(1), np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)])
    return up, down


_UP, _DOWN = _powers(_BLOCK * 2)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of every string of ``size`` bytes, from prefix sums of a polynomial."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[: len(data)], out=sums[1:])
    h = (sums[size:] - sums[:-size]) * _DOWN[: len(data) - size + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def snippets(data: bytes, length: int, gram: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, key): runs of window starts with one anchor, and the anchor's hash."""
    mask = np.uint64((1 << _PLACE_BITS) - 1)
    for begin in range(0, len(data) - length + 1, _BLOCK):
        block = np.frombuffer(data, dtype=np.uint8)[begin : begin + _BLOCK + length - 1]
        hashes = gram_hashes(block, gram)
        packed = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
        anchor = (_sliding_minimum(packed, length - gram + 1) & mask).astype(np.int64)
        cuts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        ends = np.append(cuts[1:], len(anchor)) - 1
        yield from zip((cuts + begin).tolist(), (ends + begin).tolist(), hashes[anchor[cuts]].view(np.int64).tolist())


def _anchor_batches(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                columns: list[list[int]] = [[] for _ in range(6)]
                for doc, text_hash, text in zip(*(part.column(c).to_pylist() for c in ("id", "text_hash", "text"))):
                    data = text.encode()
                    found = list(snippets(data, length, gram)) if len(data) >= length else []
                    columns[0] += [doc] * len(found)
                    columns[1] += [text_hash] * len(found)
                    columns[2] += [f for f, _, _ in found]
                    columns[3] += [e for _, e, _ in found]
                    columns[4] += [k for _, _, k in found]
                    columns[5] += [_signed(xxhash.xxh64_intdigest(data[f : e + length])) for f, e, _ in found]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)],
                    names=["id", "text_hash", "first", "last", "key", "snippet"],
                )

    return run


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _cut_batches(length: int):
    """Snippet bytes of the chosen places of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = [
                    (p["key"], p["snippet"], p["split"], p["n"], text.encode()[p["first"] : p["last"] + length])
                    for text, places in zip(part.column("text").to_pylist(), part.column("places").to_pylist())
                    for p in places
                ]
                keys, names, split, n, data = zip(*rows) if rows else ((),) * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(names, pa.int64()), pa.array(split, pa.bool_()),
                     pa.array(n, pa.int64()), pa.array(data, pa.binary())],
                    names=["key", "snippet", "split", "n", "data"],
                )

    return run


def runs_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of every run of true flags."""
    edges = np.diff(np.r_[False, flags, False].astype(np.int8))
    return list(zip(np.flatnonzero(edges == 1).tolist(), (np.flatnonzero(edges == -1) - 1).tolist()))


def repeated_starts(shards: list[list[bytes]], length: int) -> list[list[list[tuple[int, int]]]]:
    """For every snippet of every shard the runs of starts whose window also starts elsewhere in the shard."""
    out: list = [None] * len(shards)
    sizes = [sum(len(s) + 1 for s in shard) for shard in shards]
    order = sorted(range(len(shards)), key=lambda i: -sizes[i])
    first = 0
    while first < len(order):
        width = sizes[order[first]] + 1
        chosen = order[first : first + max(1, BATCH_SYMBOLS // width)]
        first += len(chosen)
        text = np.full((len(chosen), width), _FILL, dtype=np.int32)
        text[:, -1] = 0
        for row, i in enumerate(chosen):
            at = 0
            for snippet in shards[i]:
                text[row, at : at + len(snippet)] = np.frombuffer(snippet, dtype=np.uint8).astype(np.int32) + _BYTE
                text[row, at + len(snippet)] = _SEPARATOR
                at += len(snippet) + 1
        found = permuted_common_prefixes(text, suffix_arrays(text, 256 + _BYTE), length)
        for row, i in enumerate(chosen):
            out[i], at = [], 0
            for snippet in shards[i]:
                out[i].append(runs_of(found[row, at : at + max(0, len(snippet) - length + 1)]))
                at += len(snippet) + 1
    return out


_RUNS = "key long, snippet long, runs array<struct<f:int,e:int>>"


def _shard_batches(length: int):
    """Rows arrive by key; shards are gathered until a batch is full."""

    def solve(keys: list[int], names: list[list[int]], shards: list[list[bytes]]) -> pa.RecordBatch:
        runs = repeated_starts(shards, length)
        rows = [
            (k, n, [{"f": f, "e": e} for f, e in r])
            for k, ns, rs in zip(keys, names, runs) for n, r in zip(ns, rs) if r
        ]
        k, n, r = zip(*rows) if rows else ((),) * 3
        kind = pa.list_(pa.struct([("f", pa.int32()), ("e", pa.int32())]))
        return pa.RecordBatch.from_arrays(
            [pa.array(k, pa.int64()), pa.array(n, pa.int64()), pa.array(r, kind)], names=["key", "snippet", "runs"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[int] = []
        names: list[list[int]] = []
        shards: list[list[bytes]] = []
        held = 0
        for batch in batches:
            for key, name, data in zip(*(batch.column(c).to_pylist() for c in ("key", "snippet", "data"))):
                if not keys or keys[-1] != key:
                    if held > 4 * BATCH_SYMBOLS:
                        yield solve(keys, names, shards)
                        keys, names, shards, held = [], [], [], 0
                    keys.append(key)
                    names.append([])
                    shards.append([])
                if name not in names[-1]:  # a repeated row cuts the same snippet twice
                    names[-1].append(name)
                    shards[-1].append(data)
                    held += len(data)
        yield solve(keys, names, shards)

    return run


def _window_batches(length: int):
    """Content hash of every window of a split shard's snippets, with its place from the snippet's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, name, times, data in zip(*(batch.column(c).to_pylist() for c in ("key", "snippet", "n", "data"))):
                hashes = gram_hashes(np.frombuffer(data, dtype=np.uint8), length).view(np.int64)
                other = [_signed(xxhash.xxh64_intdigest(data[p : p + length])) for p in range(len(hashes))]
                n = len(hashes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, key)), pa.array(np.full(n, name)), pa.array(np.full(n, times)),
                     pa.array(np.arange(n, dtype=np.int32)), pa.array(hashes), pa.array(other, pa.int64())],
                    names=["key", "snippet", "n", "place", "h1", "h2"],
                )

    return run


def _split_runs(cut: DataFrame, length: int) -> DataFrame:
    """Runs of repeated starts of the snippets of split shards."""
    windows = cut.select("key", "snippet", "n", "data").mapInArrow(
        _window_batches(length), "key long, snippet long, n long, place int, h1 long, h2 long"
    ).distinct()
    windows = stored(windows, "split-windows")
    often = windows.groupBy("key", "h1", "h2").agg(F.sum("n").alias("total")).where("total > 1").drop("total")
    often = stored(often, "frequent-windows")
    places = windows.join(often, ["key", "h1", "h2"]).groupBy("key", "snippet").agg(
        F.sort_array(F.collect_set("place")).alias("places")  # at most a snippet's windows
    )
    run = F.transform("places", lambda p: F.struct(p.alias("f"), p.alias("e")))
    return places.select("key", "snippet", run.alias("runs"))


def _identity(id_col: str, text_col: str) -> dict[str, Column]:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return {"id": F.coalesce(F.col(id_col).cast("long"), F.lit(0)), "text_hash": F.xxhash64(text), "text": text}


def repeated_runs(docs: DataFrame, length: int = 400, gram: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_hash, starts: sorted runs of the starts of repeated windows, for texts that have any."""
    rows = docs.select(*[c.alias(n) for n, c in _identity(id_col, text_col).items()])
    anchors = stored(rows.mapInArrow(_anchor_batches(length, gram), _ANCHORS), "anchors")
    keys = anchors.groupBy("key").agg(
        F.count("*").alias("seen"), F.min("snippet").alias("_least"), F.max("snippet").alias("_most")
    ).where("seen > 1").select("key", (F.col("_least") != F.col("_most")).alias("differ"))
    # stored first: both sides of the join are then plain exchanges, and a frequent key can be split
    keys = stored(keys, "met-keys")
    met = stored(anchors.join(keys, "key"), "met-anchors")
    place = F.struct("id", "text_hash", "first", "last")
    counts = met.where("differ").groupBy("key", "snippet").agg(F.count("*").alias("n"), F.min(place).alias("place"))
    counts = stored(counts, "snippet-counts")
    size = stored(counts.groupBy("key").agg((F.count("*") > SHARD_SNIPPETS).alias("split")), "shard-sizes")
    chosen = counts.join(size, "key").groupBy("place.id", "place.text_hash").agg(
        F.collect_list(F.struct("key", "snippet", "split", "n", "place.first", "place.last")).alias("places")
    )  # at most the snippets of one text
    cut = rows.join(chosen, ["id", "text_hash"]).select("text", "places").mapInArrow(
        _cut_batches(length), "key long, snippet long, split boolean, n long, data binary"
    )
    cut = stored(cut, "snippets")
    shards = cut.where("not split").select("key", "snippet", "data").repartition("key").sortWithinPartitions("key", "snippet")
    found = shards.mapInArrow(_shard_batches(length), _RUNS)
    split = _split_runs(cut.where("split"), length)
    by_shard = stored(found.unionByName(split), "shard-runs")
    # a snippet that occurs twice is repeated in all its windows, whatever its shard says
    often = counts.where("n > 1").select("key", "snippet", F.lit(True).alias("often"))
    marks = by_shard.join(often, ["key", "snippet"], "full")
    whole = F.array(F.struct(F.lit(0).alias("f"), (F.col("last") - F.col("first")).alias("e")))
    equal = met.where("not differ").select("id", "text_hash", "first", whole.alias("runs"))
    mixed = met.where("differ").join(marks, ["key", "snippet"]).select(
        "id", "text_hash", "first", F.when(F.col("often"), whole).otherwise(F.col("runs")).alias("runs")
    )
    moved = F.transform("runs", lambda r: F.struct((r["f"] + F.col("first")).alias("f"), (r["e"] + F.col("first")).alias("e")))
    return equal.unionByName(mixed).select("id", "text_hash", moved.alias("runs")).groupBy("id", "text_hash").agg(
        F.sort_array(F.flatten(F.collect_list("runs"))).alias("starts")
    )


def removed_spans(starts: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal removed spans (begin, end) of sorted runs of starts."""
    spans: list[list[int]] = []
    for run in starts or ():
        begin, end = run["f"], run["e"] + length
        if spans and begin <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([begin, end])
    return [(b, e) for b, e in spans]


def kept_bytes(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for begin, end in spans:
        parts.append(data[at:begin])
        at = end
    parts.append(data[at:])
    return b"".join(parts)


def with_starts(docs: DataFrame, runs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_doc`` (the row), ``_text`` and ``_starts`` of every row."""
    own = _identity(id_col, text_col)
    rows = docs.select(
        F.struct("*").alias("_doc"), own["text"].alias("_text"), own["id"].alias("_id"), own["text_hash"].alias("_hash")
    )
    match = (rows["_id"] == runs["id"]) & (rows["_hash"] == runs["text_hash"])
    return rows.join(runs, match, "left").select("_doc", "_text", F.col("starts").alias("_starts"))


def _digest_batches(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "_text"):
            sizes, removed, counts, digests = [], [], [], []
            for text, starts in zip(batch.column("_text").to_pylist(), batch.column("_starts").to_pylist()):
                data = text.encode()
                spans = removed_spans(starts, length)
                sizes.append(len(data))
                removed.append(sum(e - b for b, e in spans))
                counts.append(len(spans))
                digests.append(hashlib.sha256(kept_bytes(data, spans)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(counts, pa.int64()), pa.array(digests, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return run


def digests(docs: DataFrame, length: int = 400, gram: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What is removed from every row, a digest of what is kept, the share removed and whether any is."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked = with_starts(rows, repeated_runs(rows, length, gram))
    return marked.select("_doc.doc_id", "_text", "_starts").mapInArrow(
        _digest_batches(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    ).select(
        "*", (F.col("n_removed") / F.greatest("n_bytes", F.lit(1))).alias("removed_share"), (F.col("n_spans") > 0).alias("is_cut")
    )


def cleaned(docs: DataFrame, length: int = 400, gram: int = 128) -> DataFrame:
    """``docs`` with the removed bytes cut from ``text`` (a character cut in part goes) and ``n_chars`` to match."""

    @F.pandas_udf("string")
    def kept(texts, starts):
        return texts.combine(starts, lambda text, runs: kept_bytes(
            text.encode(), removed_spans(None if runs is None else [{"f": r["f"], "e": r["e"]} for r in runs], length)
        ).decode(errors="ignore"))

    columns = docs.columns
    marked = with_starts(docs, repeated_runs(docs, length, gram))
    text = F.when(F.col("_starts").isNull(), F.col("_doc.text")).otherwise(kept("_text", "_starts"))
    out = {c: F.col(f"_doc.`{c}`") for c in columns} | {"text": text}
    if "n_chars" in columns:
        out["n_chars"] = F.when(F.col("_starts").isNull(), F.col("_doc.n_chars")).otherwise(F.length(text).cast("long"))
    return marked.select(*[c.alias(n) for n, c in out.items()])
