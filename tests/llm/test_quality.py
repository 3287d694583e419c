import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pricewatch.llm import quality


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + d for i, w in enumerate(windows) if seen[w] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
            len(covered))


def test_counts_against_plain_python(spark, odd_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(odd_docs.select("doc_id", "text"))
    for r in quality.with_counts(docs).collect():
        assert tuple(r[c] for c in quality.COUNTS) == plain_counts(r["text"]), r["text"][:80]


@pytest.mark.parametrize("n,risk,level", [(0, 0.02, 0.01), (5, 0.02, 0.01), (400, 0.02, 0.002), (3000, 0.05, 0.001), (700, 0.1, 0.2)])
def test_most_false_rejections_is_the_exact_binomial_bound(spark, n, risk, level):
    tail, k = 0.0, -1
    for i in range(n + 1):
        tail += math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(risk) + (n - i) * math.log(1 - risk))
        if tail > level:
            break
        k = i
    df = spark.range(1).select(quality.most_false_rejections(F.lit(n).cast("long"), risk, F.lit(level)).alias("k"))
    assert df.first()["k"] == k


def test_cutoffs_reject_junk_and_spare_good_text(spark):
    good = [(i, " ".join(f"w{i}x{j}" for j in range(60)), "en") for i in range(800)]
    bad = [(1000 + i, " ".join(f"w{i}y{j}###" for j in range(60)), "en") for i in range(60)]
    few = [(2000 + i, " ".join(f"v{i}y{j}###" for j in range(60)), "xx") for i in range(20)]
    docs = spark.createDataFrame(good + bad + few, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _, _ in good + bad + few], "doc_id long, quality int")
    kept = {r["doc_id"] for r in quality.verdicts(docs, labels).where("kept").collect()}
    assert kept == {i for i, _, _ in good + few}  # a stratum without enough good labels certifies nothing
    assert {r["doc_id"] for r in quality.kept(docs, labels).collect()} == kept


def test_odd_rows_and_empty_tables(odd_docs, no_docs, labels):
    assert quality.verdicts(odd_docs, labels).count() == odd_docs.count()
    assert quality.verdicts(odd_docs, labels.limit(0)).count() == odd_docs.count()
    assert quality.verdicts(no_docs, labels).count() == 0
    assert quality.kept(odd_docs, labels).columns == odd_docs.columns
