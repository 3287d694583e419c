import random
import re
import zlib
from collections import Counter

import pytest

from pricewatch.llm import queries, spelling


def plain_counts(rows, shortest, one_in):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % one_in == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= shortest:
                seen[run] += 1
    return seen


def plain(rows, shortest=7, least=2, ratio=10, one_in=31):
    n = {w: c for w, c in plain_counts(rows, shortest, one_in).items() if c >= least}
    letters = {c for w in n for c in w}
    forms, out = {}, {}
    for w in n:
        around = {w[:i] + w[i + 1 :] for i in range(len(w))}
        around |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        around |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        around = (around - {w}) & n.keys()
        best = min(around, key=lambda x: (-n[x], x), default=None)
        forms[w] = best if best is not None and n[best] >= ratio * n[w] else None
        out[w] = (len(around),)
    for w in n:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out[w] = (w, forms[w], root, n[w], out[w][0], n.get(forms[w]))
    return sorted(out.values())


def compared(docs, **options):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    most = options.pop("most_visits", spelling.MOST_VISITS)
    got = spelling.variants(docs, most_visits=most, **options)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain(rows, **options)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == want
    return want


def test_near_is_one_change():
    assert spelling.near(b"abc", b"abd") and spelling.near(b"abc", b"ab") and spelling.near(b"bc", b"abc")
    assert spelling.near(b"aab", b"ab") and spelling.near(b"", b"a")
    assert not spelling.near(b"abc", b"abc") and not spelling.near(b"abc", b"bca") and not spelling.near(b"abcd", b"ab")


def some_docs(spark, seed, words=400, docs=120):
    rng = random.Random(seed)
    syllables = ["an", "the", "ou", "ré", "ing", "st", "e", "a", "ß", "ñ", "Or"]
    known = ["".join(rng.choice(syllables) for _ in range(rng.randint(2, 6))) for _ in range(words)]
    known += ["x" * 30, "x" * 29 + "y", "x" * 31, "abcdefgh" * 40, "abcdefgh" * 40 + "z"] * 3
    weights = [1 / (i + 1) for i in range(len(known))]
    rows = []
    for i in range(docs):
        words = rng.choices(known, weights, k=rng.randint(0, 200))
        rows.append((i if i % 9 else None, rng.choice([" ", "-", ", ", "日"]).join(words)))
    chain = ["chainingword"] * 200 + ["chainingwor"] * 30 + ["chainyngwor"] * 5  # a form has a form
    rows.append((docs, " ".join(chain)))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def test_words_with_deleted_letters(spark):
    docs = some_docs(spark, 1)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for one_in in (1, 2, 31):
        got = {bytes(r["raw"]).decode("latin-1"): r["n"] for r in spelling.counts(docs, 5, one_in).collect()}
        assert got == plain_counts(rows, 5, one_in)


def test_a_long_text_is_cut_between_words(spark, monkeypatch):
    docs = some_docs(spark, 2, docs=30)
    monkeypatch.setattr(spelling, "_BYTES", 50)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = Counter()
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]})
    for block in spelling._blocks(batch):
        got.update(w.as_py().decode("latin-1") for w in spelling._words_of(*block, 5, 2))
    assert got == plain_counts(rows, 5, 2)


@pytest.mark.parametrize("most_visits", [spelling.MOST_VISITS, 300, 20])
def test_variants_against_all_neighbours(spark, most_visits):
    want = compared(some_docs(spark, 3), one_in=5, ratio=3, most_visits=most_visits)
    assert any(r[2] != r[1] for r in want if r[1]) and max(r[4] for r in want) > 3


def test_leaves_of_very_many_words(spark):
    """Words of the same letters, and of one letter less, share a few leaves."""
    rng = random.Random(5)
    words = {"".join(rng.sample("abcdefgh", 8)) for _ in range(150)}
    words |= {w[:k] + w[k + 1 :] for w in sorted(words)[:80] for k in (0, 3, 7)}
    words |= {w[:k] + "abcdefgh"[k] + w[k + 1 :] for w in sorted(words)[:80] if len(w) == 8 for k in (1, 6)}
    docs = spark.createDataFrame([(1, " ".join(sorted(words) * 2))], "doc_id long, text string")
    want = compared(docs, one_in=10**9, ratio=2, most_visits=5)
    assert max(r[4] for r in want) > 1
    with pytest.raises(ValueError):
        spelling.variants(docs, ratio=1)


def test_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    compared(odd_docs)
    assert spelling.variants(no_docs).count() == 0
    docs = spark.createDataFrame([(1, None), (None, ""), (2, "ab cd")], "doc_id long, text string")
    assert spelling.variants(docs).count() == 0


def test_query_equals_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, queries.op13_spelling(spark, sf).collect()), key=lambda r: r[0])
    assert got == plain(rows)
