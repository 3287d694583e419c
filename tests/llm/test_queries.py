"""The registered queries of the subpackage, and the pipeline."""

import duckdb
import pytest

import corpus_pipeline
from pricewatch.llm import queries, quality, simhash, suffix_dedup, toxicity

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_simhash": ["doc_id", "fingerprint", "component_id"],
    "op2_suffix": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed_share", "is_cut"],
    "op3_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op4_neighbours": ["query_id", "rank", "vec_id", "score"],
    "op5_quality": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op6_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op7_pieces": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op8_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op11_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers"],
    "op9_chat": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
}


@pytest.mark.parametrize("key", sorted(COLUMNS))
def test_query_has_a_row_for_everything(spark, key):
    got = queries.queries()[key](spark, SF)
    assert got.columns == COLUMNS[key]
    rows = {"op4_neighbours": 50, "op9_chat": 1 + spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count()}
    assert got.count() == rows.get(key, 200)


@pytest.mark.parametrize("key", sorted(queries.oracles()))
def test_query_matches_its_sql(spark, key):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"create view {name} as select * from '/root/testdata/sf0.01/{name}.parquet'")
    got = queries.queries()[key](spark, "/root/testdata/sf0.01")
    want = con.execute(queries.oracles()[key]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_pipeline_is_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.learn(docs, labels)
    toxic = {r["doc_id"] for r in toxicity.scores(docs, model).where("score >= 0.3").collect()}
    kept = docs.where(~docs["doc_id"].isin(sorted(toxic) or [-1]))
    good = {r["doc_id"] for r in quality.verdicts(kept, labels).where("kept").collect()}
    kept = kept.where(kept["doc_id"].isin(sorted(good)))
    first = {r["component_id"] for r in simhash.components(kept).collect()}
    kept = kept.where(kept["doc_id"].isin(sorted(first)))
    assert suffix_dedup.cleaned(kept).columns == docs.columns
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in packed} == first


def test_stages_survive_odd_rows(spark, odd_docs, tmp_path):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = odd_docs.withColumn("source", odd_docs["key"]).withColumn("n_chars", odd_docs["id"])
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns and got.count() >= 0
