"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most ``d`` bits apart share a variant: with r = d // 2, both reach a common
point within r flips when their distance is at most 2r. For odd d the distance 2r + 1 remains; then
their parities differ, and the odd one also emits its variants at r + 1 flips. Of those only flips
within one half of the bits are needed, for of 2r + 1 differing bits r + 1 lie in one half.

Variants are shuffled by their leading bits. All variants of a fingerprint that share them travel
as one row and are made at their destination, so a fingerprint costs tens of rows, not thousands.
A bucket of very many variants (edited copies share their leading bits) is split further by parities
of random sets of bits: close fingerprints differ in them, equal variants do not, so each variant is
still made once and every group is bounded. There the variants are sorted; members of one variant are linked to its first member within r
flips, each link is verified on the bit distance, and the links of a bucket are reduced to a
forest. Components come from star rounds over the forests.

Distinct fingerprints are linked, so copies count once. Fewer words than a shingle: the whole
sequence is the one shingle. No words, empty or null text: fingerprint zero, linked like any other.
A null id is never the smallest of its component unless all are null; repeated rows each get a row;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewatch.llm.common import sliced, stored
from pricewatch.llm.components import roots

BITS = 64
SEED = 42
#: Fingerprints for which a bucket is the home, on average; the leading bits follow from it.
HOME = 256
#: Variants made and sorted at once; a bucket with more is split into parts of about as many.
AT_ONCE = 2_000_000
#: Sets of bits whose parities tell the parts of a bucket apart.
PARITIES = np.random.default_rng(SEED).integers(0, 1 << 64, 24, dtype=np.uint64)
#: Hashes unpacked at once.
_BLOCK = 1 << 16


def fingerprint(text: str | None, words_per_shingle: int) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, ASCII white space
    if not words:
        return 0
    k = min(words_per_shingle, len(words))
    shingles = map(b" ".join, zip(*[words[i:] for i in range(k)]))
    hashes = np.array(list(map(xxhash.xxh64_intdigest, shingles, repeat(SEED))), dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for first in range(0, len(hashes), _BLOCK):
        block = hashes[first : first + _BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprint_batches(words_per_shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            prints = [fingerprint(t, words_per_shingle) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.array(prints, dtype=np.uint64).view(np.int64))],
                names=["doc_id", "fingerprint"],
            )

    return run


def fingerprints(
    docs: DataFrame, words_per_shingle: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, fingerprint (signed 64 bits)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprint_batches(words_per_shingle), "doc_id long, fingerprint long")


class Ball:
    """Flip masks of the ball, grouped by their key: the leading bits, then ``extra`` parities.

    Both are linear, so the key of a variant is the fingerprint's key with the mask's key flipped.
    """

    def __init__(self, distance: int, lead: int, extra: int = 0) -> None:
        self.distance, self.lead, self.shift, self.extra = distance, lead, np.uint64(BITS - lead), extra
        r = distance // 2
        near = [c for n in range(r + 1) for c in combinations(range(BITS), n)]
        halves = (range(BITS // 2), range(BITS // 2, BITS))
        far = [c for half in halves for c in combinations(half, r + 1)] if distance % 2 else []
        self.near, self.far = self._grouped(near), self._grouped(far)

    def keys(self, values: np.ndarray) -> np.ndarray:
        keys = (values >> self.shift).astype(np.int64)
        for bits in PARITIES[: self.extra]:
            keys = keys << 1 | np.bitwise_count(values & bits) % 2
        return keys

    def _grouped(self, flips: list[tuple[int, ...]]) -> dict[int, np.ndarray]:
        masks = np.array([sum(1 << b for b in c) for c in flips], dtype=np.uint64)
        keys = self.keys(masks)
        return {int(x): masks[keys == x] for x in np.unique(keys)}

    def destinations(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, fingerprint) rows: every bucket that holds a variant of the fingerprint."""
        home = self.keys(prints)
        odd = np.bitwise_count(prints) % 2 == 1
        buckets, owners = [], []
        for flip in self.near.keys() | self.far.keys():
            chosen = slice(None) if flip in self.near else odd
            buckets.append(home[chosen] ^ flip)
            owners.append(prints[chosen])
        return np.concatenate(buckets), np.concatenate(owners)

    def counts(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, variants of these fingerprints in it)."""
        home = self.keys(prints)
        odd = np.bitwise_count(prints) % 2 == 1
        buckets, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for groups, own in ((self.near, home), (self.far, home[odd])):
            homes, n = np.unique(own, return_counts=True)
            for flip, masks in groups.items():
                buckets.append(homes ^ flip)
                sizes.append(n * len(masks))
        found, place = np.unique(np.concatenate(buckets), return_inverse=True)
        return found, np.bincount(place, np.concatenate(sizes), len(found)).astype(np.int64)

    def parts(self, bucket: int, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(part, fingerprint) rows: every part of the bucket (of leading bits) that holds a variant."""
        low = (1 << self.extra) - 1
        flip = (prints >> self.shift).astype(np.int64) ^ bucket
        odd = np.bitwise_count(prints) % 2 == 1
        for wanted, keys in ((~odd, set(self.near)), (odd, self.near.keys() | self.far.keys())):
            keys = np.array(sorted(keys), dtype=np.int64)
            for x in np.unique(flip[wanted]).tolist():
                own, flips = prints[wanted & (flip == x)], keys[keys >> self.extra == x] & low
                step = max(1, 100_000 // max(1, len(flips)))
                for first in range(0, len(own), step):
                    some = own[first : first + step]
                    part = (self.keys(some) & low)[:, None] ^ flips[None, :]
                    yield part.ravel(), np.repeat(some, len(flips))

    def variants(self, bucket: int, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(owner, variants, within r flips) of the fingerprints, for variants in the bucket of this key."""
        flip = self.keys(prints) ^ bucket
        odd = np.bitwise_count(prints) % 2 == 1
        for groups, wanted, near in ((self.near, None, True), (self.far, odd, False)):
            for x in np.unique(flip).tolist():
                if x in groups:
                    at = np.flatnonzero((flip == x) if wanted is None else (flip == x) & wanted)
                    step = max(1, AT_ONCE // len(groups[x]))
                    for first in range(0, len(at), step):
                        own = at[first : first + step]
                        yield (
                            np.repeat(own, len(groups[x])), (prints[own][:, None] ^ groups[x][None, :]).ravel(), near
                        )

    def links(self, bucket: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forest over the fingerprints (distinct) that meet in this bucket: (fingerprint, root)."""
        label = np.arange(len(prints))
        total = sum(len(v) for _, v, _ in self.variants(bucket, prints))
        passes = ceil(total / AT_ONCE)
        for turn in range(passes):  # equal variants fall into the same pass
            parts = [
                (o[chosen], v[chosen], np.full(int(chosen.sum()), near))
                for o, v, near in self.variants(bucket, prints)
                for chosen in [_mixed(v) % np.uint64(passes) == turn]
            ]
            owner, variant, near = (np.concatenate(x) for x in zip(*parts))
            order = _by_variant(variant, near)
            owner, variant, near = owner[order], variant[order], near[order]
            starts = np.flatnonzero(np.r_[True, variant[1:] != variant[:-1]])
            size = np.diff(np.append(starts, len(variant)))
            met = (size > 1) & near[starts]
            head = np.repeat(owner[starts[met]], size[met])
            other = owner[np.repeat(met, size)]
            apart = np.bitwise_count(prints[head] ^ prints[other])
            true = (apart <= self.distance) & (head != other)
            label = _joined(label, head[true], other[true])
        child = np.flatnonzero(label != np.arange(len(prints)))
        return prints[child], prints[label[child]]


def _mixed(values: np.ndarray) -> np.ndarray:
    return (values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)


def _by_variant(variant: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Order by variant, members within r flips first."""
    order = np.argsort(~near, kind="stable")
    return order[np.argsort(variant[order], kind="stable")]


def _joined(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest label of every set after joining the links; labels are places, as links are."""
    while len(left):
        a, b = label[left], label[right]
        apart = a != b
        if not apart.any():
            break
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != label[label]).any():
            label = label[label]
    return label


def near_links(prints: DataFrame, distance: int = 3) -> DataFrame:
    """Links between distinct fingerprints that connect exactly those at most ``distance`` apart, transitively."""
    n = prints.count()
    lead = min(24, max(4, ceil(log2(n / HOME)))) if n > HOME else 4

    ball = Ball(distance, lead)
    split: dict[int, int] = {}  # bucket: parities that tell its parts apart

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, variants = ball.counts(batch.column("fingerprint").to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int32)), pa.array(variants)], names=["bucket", "n"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = {extra: Ball(distance, lead, extra) for extra in set(split.values())}
        hot = np.array(sorted(split), dtype=np.int64)

        def rows(buckets: np.ndarray, parts: np.ndarray, owners: np.ndarray) -> Iterator[pa.RecordBatch]:
            for first in range(0, len(buckets), 100_000):
                cut = slice(first, first + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(buckets[cut].astype(np.int32)), pa.array(parts[cut].astype(np.int32)),
                     pa.array(owners[cut].view(np.int64))],
                    names=["bucket", "part", "fingerprint"],
                )

        for batch in batches:
            buckets, owners = ball.destinations(batch.column("fingerprint").to_numpy().view(np.uint64))
            whole = ~np.isin(buckets, hot)
            yield from rows(buckets[whole], np.zeros(int(whole.sum()), dtype=np.int32), owners[whole])
            buckets, owners = buckets[~whole], owners[~whole]
            for b in np.unique(buckets).tolist():
                for parts, own in balls[split[b]].parts(b, owners[buckets == b]):
                    yield from rows(np.full(len(own), b), parts, own)

    made: dict[int, Ball] = {}

    def meet(key: tuple, rows: pa.Table) -> pa.Table:
        bucket, part = (k.as_py() for k in key)
        extra = split.get(bucket, 0)
        if extra not in made:
            made[extra] = Ball(distance, lead, extra)
        own = np.unique(rows.column("fingerprint").to_numpy()).view(np.uint64)
        child, root = made[extra].links(bucket << extra | part, own)
        return pa.table({"node": child.view(np.int64), "near": root.view(np.int64)})

    bare = prints.select("fingerprint")
    sizes = bare.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in sizes.where(F.col("n") > AT_ONCE).collect():  # at most all variants / AT_ONCE rows
        split[r["bucket"]] = min(len(PARITIES), ceil(log2(r["n"] / AT_ONCE)))
    return (
        bare.mapInArrow(emit, "bucket int, part int, fingerprint long")
        .groupBy("bucket", "part").applyInArrow(meet, "node long, near long")
    )


def components(
    docs: DataFrame, words_per_shingle: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id of the component)."""
    prints = stored(fingerprints(docs, words_per_shingle, id_col, text_col), "fingerprints")
    distinct = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("_least_id")), "distinct-fingerprints")
    root = roots(near_links(distinct, distance))
    joined = distinct.join(root, distinct["fingerprint"] == root["node"], "left").select(
        "fingerprint", "_least_id", F.coalesce("root", "fingerprint").alias("_root")
    )
    least = joined.groupBy("_root").agg(F.min("_least_id").alias("component_id"))
    of_print = stored(joined.join(least, "_root").select("fingerprint", "component_id"), "print-components")
    return prints.join(of_print, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def representatives(docs: DataFrame, words_per_shingle: int = 3, distance: int = 3) -> DataFrame:
    """One row of every component, that of its smallest id, with the columns of ``docs``.

    Rows that share that id and text are one document; of rows that share the id but not the text
    all stay, and so do rows of components whose ids are all null.
    """
    found = components(docs, words_per_shingle, distance)
    rows = docs.dropDuplicates(["doc_id", "text"]) if _repeats(found) else docs
    lead = found.where("doc_id is null or doc_id = component_id").select("doc_id").distinct()
    lead = stored(lead, "first-of-component")
    return rows.join(lead, rows["doc_id"].eqNullSafe(lead["doc_id"]), "left_semi")


def _repeats(found: DataFrame) -> bool:
    """Whether an id occurs twice."""
    return not found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
