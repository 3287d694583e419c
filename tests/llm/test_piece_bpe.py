import hashlib
import random

import pytest
import sentencepiece

from pricewatch.llm import piece_bpe
from pricewatch.llm.common import tokenizer_file

PATH = tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_same_ids_and_text_as_the_library(library):
    rng = random.Random(7)
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    letters = "abcdefghij  tion the  ▁\t\n<>é日本😀\x00\x01\u200b\u0301ß.,--==000"
    texts = ["", " ", "  ", " " * 300, "a" * 300, "-" * 300, "日本語" * 50]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(800)]
    want = library.encode(texts)
    assert piece_bpe.encode(texts) == want
    model = piece_bpe.load(PATH)
    assert [model.decode(ids) for ids in want] == [library.decode(ids) for ids in want]
    assert model.decode([3 + 0xE6, 3 + 0x97, 300]) == library.decode([3 + 0xE6, 3 + 0x97, 300])


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_rows_of_documents_and_odd_rows(spark, library, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(odd_docs.select("doc_id", "text"))
    want = []
    for r in docs.collect():
        ids = library.encode(r["text"] or "")
        want.append((r["doc_id"], len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids))))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in piece_bpe.encode_digests(docs).collect())
    assert piece_bpe.encode_digests(no_docs).count() == 0
