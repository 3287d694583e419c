import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from pricewatch.llm import packing
from pricewatch.llm.common import tokenizer_file


@pytest.mark.parametrize("n", [0, 1, 5, 300, 50_000])
def test_plan_covers_the_histogram_with_little_padding(n):
    rng = np.random.default_rng(1)
    sizes = np.minimum(np.ceil(rng.lognormal(6.2, 1.1, n) / 64), 64).astype(int)
    histogram = dict(zip(*(a.tolist() for a in np.unique(sizes, return_counts=True)))) if n else {}
    covered: Counter = Counter()
    patterns = packing.plan(histogram, 64)
    for pattern, times in patterns:
        assert sum(s * a for s, a in pattern.items()) <= 64
        covered.update({s: a * times for s, a in pattern.items()})
    assert dict(covered) == histogram
    least = -(-int(sizes.sum()) // 64) if n else 0
    assert sum(t for _, t in patterns) <= 1.01 * least + 2


def test_pieces_and_sequences(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(odd_docs.select("doc_id", "text").dropDuplicates(["doc_id"]).selectExpr("100000 + doc_id as doc_id", "text"))
    docs = docs.where("doc_id is not null")
    tokenizer = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    ids = {r["doc_id"]: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    got = packing.pack(docs).collect()
    covered, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        own = ids[r["doc_id"]]
        piece = np.array(own[r["start"] : r["start"] + r["length"]], dtype="<u4")
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(piece.tobytes()) and len(piece) == r["length"]
        covered[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, parts in covered.items():
        assert gapless(parts) == len(ids[doc])
    assert set(covered) == set(ids) and sorted(sequences) == list(range(len(sequences)))
    assert all(gapless(parts) <= 4096 for parts in sequences.values())
    assert packing.pack(no_docs).count() == 0
    assert packing.pack(odd_docs).selectExpr("sum(length)").first()[0] > 0


def gapless(parts):
    end = 0
    for start, length in sorted(parts):
        assert start == end
        end += length
    return end
