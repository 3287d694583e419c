import random

import numpy as np
import xxhash

from pricewatch.llm import simhash

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text, k):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(
        {c: " " for c in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids, distance):
    group = list(range(len(prints)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = root(i), root(j)
                group[max(a, b)] = min(a, b)
    found = {}
    for i, doc in enumerate(ids):
        if doc is not None:
            r = root(i)
            found[r] = min(found.get(r, doc), doc)
    return [found.get(root(i)) for i in range(len(prints))]


def compared(docs, distance=3):
    rows = docs.select("doc_id", "text").collect()
    prints = [plain_fingerprint(r["text"], 3) for r in rows]
    components = plain_components(prints, [r["doc_id"] for r in rows], distance)
    want = sorted(map(repr, zip([r["doc_id"] for r in rows], [f"{p:016x}" for p in prints], components)))
    got = simhash.components(docs, 3, distance).collect()
    assert sorted(repr(tuple(r)) for r in got) == want


def test_documents_and_planted_near_copies(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rng = random.Random(5)
    near = []
    for r in docs.limit(40).collect():
        words = r["text"].split()
        words[rng.randrange(len(words))] = "changed"
        near.append((10_000 + r["doc_id"], " ".join(words)))
    compared(docs.unionByName(spark.createDataFrame(near, docs.schema)))


def test_odd_rows_and_empty_table(odd_docs, no_docs):
    compared(odd_docs)
    assert simhash.components(no_docs).count() == 0


def test_balls_find_every_pair_at_any_distance(monkeypatch):
    rng = np.random.default_rng(1)
    for distance in (1, 2, 3, 4):
        base = rng.integers(0, 2**63, 60, dtype=np.uint64) * 2
        prints = np.unique(np.concatenate([base] + [
            base ^ np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in base],
                            dtype=np.uint64) for _ in range(3)]))
        monkeypatch.setattr(simhash, "AT_ONCE", 3000)  # several passes over one bucket
        ball = simhash.Ball(distance, 6)
        buckets, owners = ball.destinations(prints)
        label = np.arange(len(prints))
        for b in np.unique(buckets):
            child, root = ball.links(int(b), np.unique(owners[buckets == b]))
            label = simhash._joined(label, np.searchsorted(prints, child), np.searchsorted(prints, root))
        want = plain_components([int(p) for p in prints], list(range(len(prints))), distance)
        assert label.tolist() == want


def test_representatives_keep_the_columns(odd_docs):
    kept = simhash.representatives(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(10) == 1 and 11 not in ids and ids.count(None) == 2


def test_a_bucket_of_edited_copies_is_split_into_bounded_groups(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centre = np.uint64(0xFEDCBA9876543210)
    edits = [sum(1 << int(b) for b in rng.choice(40, rng.integers(0, 5), replace=False)) for _ in range(400)]
    prints = np.unique(np.concatenate([centre ^ np.array(edits, dtype=np.uint64), rng.integers(0, 1 << 64, 50, dtype=np.uint64)]))
    variants = sum(len(v) for b in range(16) for _, v, _ in simhash.Ball(3, 4).variants(b, prints))
    largest = []

    def spied(ball, key, own):
        largest.append((sum(len(v) for _, v, _ in ball.variants(key, own)), len(own)))
        return links(ball, key, own)

    links = simhash.Ball.links
    for distance in (1, 2, 3, 4):
        whole, parts = simhash.Ball(distance, 4), simhash.Ball(distance, 4, 5)
        assert sum(whole.counts(prints)[1]) == sum(len(v) for b in range(16) for _, v, _ in whole.variants(b, prints))
        label, made = np.arange(len(prints)), 0
        buckets, owners = whole.destinations(prints)
        for b in np.unique(buckets).tolist():
            rows = list(parts.parts(b, owners[buckets == b]))
            part, own = (np.concatenate(x) for x in zip(*rows))
            for one in np.unique(part).tolist():
                child, root = spied(parts, b << 5 | one, np.unique(own[part == one]))
                label = simhash._joined(label, np.searchsorted(prints, child), np.searchsorted(prints, root))
                made += largest[-1][0]
        assert made == sum(whole.counts(prints)[1])  # every variant is made once
        assert label.tolist() == plain_components([int(p) for p in prints], list(range(len(prints))), distance)
        if distance == 3:
            assert max(n for n, _ in largest) < variants / 16

    monkeypatch.setattr(simhash, "AT_ONCE", 4000)
    frame = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fingerprint long")
    found = simhash.near_links(frame, 3).collect()
    order = {int(p): i for i, p in enumerate(prints.view(np.int64))}
    label = simhash._joined(np.arange(len(prints)), np.array([order[r["node"]] for r in found]), np.array([order[r["near"]] for r in found]))
    assert label.tolist() == plain_components([int(p) for p in prints], list(range(len(prints))), 3)
    assert "part" in simhash.near_links(frame, 3)._jdf.queryExecution().analyzed().toString()
