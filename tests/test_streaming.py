"""Streamed sheets: their own headers, refused sheets, results of touched series."""

import datetime as dt

from pyspark.sql import functions as F

from pricewatch.catalog.fixture import SETTINGS
from pricewatch.streaming import ingest

NOW = dt.datetime(2002, 1, 1)


def rows(spark, path, *columns):
    return sorted(tuple(r) for r in spark.read.parquet(path).select(*columns).collect())


def test_every_sheet_is_read_by_its_own_header(spark, tmp_path):
    folder, table = tmp_path / "in", str(tmp_path / "t")
    folder.mkdir()
    (folder / "1.csv").write_text("series_id,batch_no,row_no,tanggal,harga\ns,1,1,01/01/2022,1.000\n")
    (folder / "2.csv").write_text("Harga ,note,Tanggal,row_no,series_id,batch_no\n2.000,\"a, b\",02/01/2022,1,s,2\ntanggal,harga,x,1,s,2\n")
    (folder / "3.csv").write_text("series_id,batch_no,row_no,when,harga\ns,3,1,03/01/2022,3.000\n")
    (folder / "4.csv").write_text("series_id,batch_no,row_no,tanggal,harga\ns,4,1,04/01/2022,4.000\ns,4,2,99/99/2022,5.000\n")
    ingest.stream_upserts(spark, str(folder), table, str(tmp_path / "c")).awaitTermination()
    assert rows(spark, table, "date", "price") == [(dt.date(2022, 1, 1), 1000.0), (dt.date(2022, 1, 2), 2000.0)]
    refused = rows(spark, f"{table}-rejected", F.regexp_extract("file_path", r"(\d)\.csv", 1).alias("f"), "reason")
    assert refused == [("3", "no column tanggal"), ("4", "a date does not parse"), ("4", "a date does not parse")]


def test_results_of_touched_series_follow_once(spark, tmp_path, monkeypatch):
    folder, table, root = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "r")
    folder.mkdir()
    head = "series_id,batch_no,row_no,tanggal,harga\n"

    def sheet(name, series, batch, start, days, scale=1.0):
        first = dt.date.fromisoformat(start)
        lines = [
            f"{series},{batch},{i},{(first + dt.timedelta(i)).isoformat()},{int(scale * (1000 + i * 37 % 91))}"
            for i in range(days)
        ]
        (folder / name).write_text(head + "\n".join(lines) + "\n")

    def run(checkpoint):
        refresh = ingest.refresh_results(table, root, lambda: NOW, SETTINGS)
        ingest.stream_upserts(spark, str(folder), table, str(tmp_path / checkpoint), refresh=refresh).awaitTermination()

    sheet("a.csv", "a", 1, "2000-01-01", 500)
    run("c")
    assert {r[0] for r in rows(spark, f"{root}/forecast", "series_id")} == {"a"}
    before = rows(spark, f"{root}/forecast", "series_id", "horizon", "step", "yhat")
    sheet("b.csv", "b", 2, "2000-01-01", 500, 2.0)
    run("c")
    assert {r[0] for r in rows(spark, f"{root}/forecast", "series_id")} == {"a", "b"}
    after = rows(spark, f"{root}/forecast", "series_id", "horizon", "step", "yhat")
    assert [r for r in after if r[0] == "a"] == before
    risks = rows(spark, f"{root}/risk_status", "batch_id", "series_id", "horizon", "risk_score")
    assert [(b, s) for b, s, _, _ in risks] == [(0, "a")] * 3 + [(1, "b")] * 3
    merge = ingest.merge_into(table, f"{table}-rejected", ingest.refresh_results(table, root, lambda: NOW, SETTINGS))
    cells = spark.read.schema(ingest.schemas.raw_sheet(ingest.WIDTH)).csv(str(folder / "b.csv")).withColumns(
        {"file_path": F.col("_metadata.file_path"), "block_start": F.col("_metadata.file_block_start")}
    )
    merge(cells, 1)  # the second batch once more
    assert rows(spark, f"{root}/risk_status", "batch_id", "series_id", "horizon", "risk_score") == risks
    assert rows(spark, f"{root}/forecast", "series_id", "horizon", "step", "yhat") == after
