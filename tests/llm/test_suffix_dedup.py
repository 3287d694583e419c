import hashlib
import random
from collections import Counter

import numpy as np

from pricewatch.llm import suffix_array, suffix_dedup


def test_suffix_arrays_and_common_prefixes():
    rng = np.random.default_rng(0)
    for trial in range(40):
        rows, n, k = int(rng.integers(1, 8)), int(rng.integers(1, 50)), int(rng.integers(1, 5))
        text = rng.integers(1, k + 1, (rows, n))
        if trial % 3 == 0:
            text = np.tile(text[:, :3], (1, n // 3 + 1))[:, :n]
        text = np.concatenate([text, np.zeros((rows, 1), dtype=int)], axis=1)
        order = suffix_array.suffix_arrays(text, k + 1)
        m = int(rng.integers(1, 6))
        found = suffix_array.permuted_common_prefixes(text, order, m)
        for r in range(rows):
            assert order[r].tolist() == sorted(range(text.shape[1]), key=lambda i: text[r, i:].tolist())
            starts = [tuple(text[r, i : i + m]) for i in range(text.shape[1])]
            seen = Counter(starts)
            assert found[r].tolist() == [len(s) == m and seen[s] > 1 for s in starts]


def plain(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, dtype=bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = suffix_dedup.runs_of(gone[:-1]) if len(d) else []
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), int(gone.sum()), len(runs), hashlib.sha256(kept).hexdigest()))
    return out


def compared(docs, length, gram):
    rows = docs.select("doc_id", "text").collect()
    want = sorted(repr((r["doc_id"], *p)) for r, p in zip(rows, plain([r["text"] for r in rows], length)))
    got = suffix_dedup.digests(docs, length, gram).collect()
    assert sorted(repr(tuple(r)[:5]) for r in got) == want
    for r in got:
        assert r["is_cut"] == (r["n_removed"] > 0) and r["removed_share"] == r["n_removed"] / max(1, r["n_bytes"])


def test_random_texts_with_shared_passages(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(n) for n in (12, 15, 20, 60)]
    texts = [prose(40) for _ in range(30)]
    texts += [prose(5) + " " + rng.choice(passages) + " " + prose(9) for _ in range(60)]  # more than one shard holds
    texts += ["ab" * 60, "a" * 200, "a" * 39, passages[3] * 3, texts[0], texts[0], None, "", texts[1][:45]]
    docs = spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for most in (1000, suffix_dedup.SHARD_SNIPPETS, 12):  # whole shards, and keys split by content
        monkeypatch.setattr(suffix_dedup, "SHARD_SNIPPETS", most)
        compared(docs, 40, 13)


def test_odd_rows_and_empty_table(odd_docs, no_docs):
    compared(odd_docs, 400, 128)
    assert suffix_dedup.digests(no_docs).count() == 0


def test_cleaned_keeps_columns_and_cuts_text(spark):
    passage = " ".join(f"word{i}" for i in range(80))
    docs = spark.createDataFrame(
        [(1, "first;" + passage + "!end", 7, "k"), (2, "other é" + passage, 7, "k"), (3, None, None, "k"), (4, "alone", 5, "k")],
        "doc_id long, text string, n_chars long, key string",
    )
    got = {r["doc_id"]: r for r in suffix_dedup.cleaned(docs, 400, 128).collect()}
    assert suffix_dedup.cleaned(docs).columns == docs.columns
    assert got[1]["text"] == "first;!end" and got[1]["n_chars"] == 10
    assert got[2]["text"] == "other é" and got[3]["text"] is None and got[4]["text"] == "alone"
