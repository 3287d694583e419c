import numpy as np

from pricewatch.llm import language


def test_held_out_accuracy_and_scores(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs.where(~language.held_out()))
    held = docs.where(language.held_out())
    got = {r["doc_id"]: r for r in language.predict(held, model).collect()}
    truth = {r["doc_id"]: r["lang"] for r in held.select("doc_id", "lang").collect()}
    assert np.mean([got[d]["lang_pred"] == truth[d] for d in truth]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert 0 < (model.weights != 0).mean() < 0.5  # the penalty leaves most weights at zero


def test_blocks_give_the_same_grams(monkeypatch):
    codes = language.letter_codes("Straße und ÉTÉ 123 " * 20)
    whole = np.sort(np.concatenate(list(language.gram_blocks(codes))))
    monkeypatch.setattr(language, "_BLOCK", 7)
    assert (np.sort(np.concatenate(list(language.gram_blocks(codes)))) == whole).all()


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(0)
    labels = rng.integers(0, 3, 500)
    logits = rng.normal(0, 1, (500, 3)) + 2 * np.eye(3)[labels]
    assert 1.5 < language.best_temperature(3 * logits, labels) / language.best_temperature(logits, labels) < 4.5


def test_odd_rows_and_empty_tables(odd_docs, no_docs):
    model = language.train(odd_docs)
    got = language.predict(odd_docs, model).collect()
    assert len(got) == odd_docs.count()
    assert {r["lang_pred"] for r in got if r["doc_id"] in (0, 1, 2, 13)} == {"und"}
    assert language.predict(no_docs, model).count() == 0
    untaught = language.train(odd_docs.where("lang is null"))
    assert {r["lang_pred"] for r in language.predict(odd_docs, untaught).collect()} == {"und"}


def test_rows_without_id_do_not_swell_the_sample(spark, monkeypatch):
    rows = [(None if i % 3 == 0 else i, f"text number {i} of many", "en" if i % 2 else "de") for i in range(6000)]
    rows += [(None, "the same text", "en")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    real = language.ftrl
    monkeypatch.setattr(language, "ftrl", lambda fit, *a, **k: seen.append(len(fit)) or real(fit, *a, **k))
    language.train(docs, sample_rows=300)
    assert 100 < seen[0] < 400
