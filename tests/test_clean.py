"""Sheets: headers, parsing, validity rules, merging."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pricewatch.operators import clean, merge
from pricewatch.sources import sheets


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_upload_is_cleaned(spark):
    raw = spark.createDataFrame(
        [("01/02/2022", "45.000"), ("2022-02-13", "1,250"), ("03/02/2022", "n/a"),
         ("04/02/2022", "0"), ("05/02/2022", None), (None, "9"), ("06/02/2022", "nan")],
        "` Tanggal ` string, HARGA string",
    )
    assert rows(clean.clean_upload(raw), "date", "price") == [
        (dt.date(2022, 2, 1), 45000.0), (dt.date(2022, 2, 13), 1250.0)]


def test_upload_fails_on_a_bad_date_of_a_kept_row(spark):
    raw = spark.createDataFrame([("13/13/2022", "5")], "date string, price string")
    with pytest.raises(Exception, match="unparsable date"):
        clean.clean_upload(raw).collect()
    unused = spark.createDataFrame([("13/13/2022", "x"), ("01/01/2022", "5")], "date string, price string")
    assert clean.clean_upload(unused).count() == 1


def test_numeric_prices_keep_their_point(spark):
    raw = spark.createDataFrame([("01/01/2022", 45000.5)], "date string, price double")
    assert rows(clean.clean_upload(raw), "price") == [(45000.5,)]


def test_missing_columns_are_refused(spark):
    with pytest.raises(ValueError, match="price"):
        clean.clean_upload(spark.createDataFrame([("x", "y")], "date string, value string"))


def test_last_matching_header_wins(spark):
    raw = spark.createDataFrame([("01/01/2022", "1", "2")], "date string, price string, harga string")
    assert rows(clean.clean_upload(raw), "price") == [(2.0,)]


def test_folder_import(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Tanggal,Harga\n01/01/2022,1.000\n02/01/2022,0\n")
    (tmp_path / "b.csv").write_text("id,Price (Rp),Date\n7,\"2,000\",2022-01-03\n")
    (tmp_path / "c.csv").write_text("Tanggal,Catatan\n04/01/2022,5\n")
    (tmp_path / "d.csv").write_text("date,price\n05/01/2022,5\n06/01/2022,oops\n")
    (tmp_path / "e.csv").write_text("date,price\n07/01/2022,\n08/01/2022,6\n")
    cells = sheets.read_cells(spark, str(tmp_path))
    width = sheets.width_of(cells)
    got = clean.import_sheets(cells, width)
    assert {(r["file_path"][-5:], r["reason"]) for r in clean.rejected_sheets(cells, width).collect()} == {
        ("c.csv", "no price column"), ("d.csv", "a price does not parse")}
    assert rows(got, "date", "price") == [
        (dt.date(2022, 1, 1), 1000.0), (dt.date(2022, 1, 3), 2000.0), (dt.date(2022, 1, 8), 6.0)]


def test_header_words_in_data_and_wide_sheets(spark, tmp_path):
    wide = ",".join(f"n{i}" for i in range(18))
    (tmp_path / "wide.csv").write_text(f"{wide},date,price\n{wide},01/01/2022,5\n")
    (tmp_path / "note.csv").write_text("date,price,note\n02-01-2022,6,Harga\n2022-01-03 00:00:00,7,date\n")
    (tmp_path / "suffix.csv").write_text("date,price\n04/01/2022,5d\n")
    cells = sheets.read_cells(spark, str(tmp_path))
    got = clean.import_sheets(cells, sheets.width_of(cells))
    assert rows(got, "date", "price") == [
        (dt.date(2022, 1, 1), 5.0), (dt.date(2022, 1, 2), 6.0), (dt.date(2022, 1, 3), 7.0)]


def test_read_upload(spark, tmp_path):
    path = tmp_path / "up.csv"
    path.write_text("Tanggal,Harga\n01/01/2022,1.000\n")
    df = sheets.read_upload(spark, str(path))
    assert rows(clean.clean_upload(df), "price") == [(1000.0,)]
    with pytest.raises(ValueError, match="invalid file format"):
        sheets.read_upload(spark, str(tmp_path / "up.pdf"))


def test_yearly_sheets(spark, tmp_path):
    (tmp_path / "2022.csv").write_text("Date,Price (Rp)\n2022-01-01,5\n2022-01-01,6\n2022-01-02,-1\n")
    (tmp_path / "2023.csv").write_text("Price(Rp),Date\n7,2023-01-01\n9,2022-01-02\n")
    frames = sheets.read_yearly(
        spark,
        [str(tmp_path / "2022.csv"), str(tmp_path / "none.csv"), str(tmp_path / "2023.csv")],
    )
    numbered = [
        f.withColumns({"series_id": F.lit("s"), "file_no": F.lit(i),
                       "row_no": F.monotonically_increasing_id(), "date": F.to_date("date")})
        for i, f in enumerate(frames)
    ]
    got = clean.load_yearly(numbered, ("file_no", "row_no"))
    # The first row of 2022-01-02 is not positive, so the day is dropped.
    assert rows(got, "date", "price") == [(dt.date(2022, 1, 1), 5.0), (dt.date(2023, 1, 1), 7.0)]
    with pytest.raises(FileNotFoundError):
        clean.concat_sheets([])


WRITES = "series_id string, date date, price double, batch_no int, row_no bigint"


def test_upsert_last_write_wins_in_any_order(spark):
    day = dt.date(2022, 1, 1)
    old = spark.createDataFrame([("s", day, 1.0, 1, 5)], WRITES)
    new = spark.createDataFrame([("s", day, 2.0, 2, 1), ("s", day, None, 2, 0)], WRITES)
    for df in (merge.upsert(old, new), merge.upsert(merge.upsert(old, new), new), merge.upsert(new, old)):
        assert rows(df, "price", "batch_no") == [(2.0, 2)]


def test_order_key_of_two_integers_is_hashable(spark):
    df = spark.createDataFrame(
        [("s", dt.date(2022, 1, 1), float(i), b, r) for i, (b, r) in enumerate([(1, 2**62), (2, -5), (2, -4)])],
        WRITES,
    )
    last = merge.last_per_key(df, ("batch_no", "row_no"))
    assert rows(last, "price") == [(2.0,)]
    assert rows(merge.first_per_key(df, ("batch_no", "row_no")), "price") == [(0.0,)]
    plan = last._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_append_unique_chain(spark):
    days = [dt.date(2022, 1, d) for d in range(1, 9)]
    content = {
        1: [0, 1],        # accepted
        2: [1, 2],        # meets 1
        3: [2, 3],        # only meets 2, which is rejected: accepted
        4: [3, 4],        # meets 3
        5: [5, 5],        # repeats a day
        6: [6],           # stored already
        7: [5, 7],        # only meets 5: accepted
    }
    files = spark.createDataFrame(
        [("s", days[i], 1.0, f) for f, dates in content.items() for i in dates],
        "series_id string, date date, price double, file_no int",
    )
    stored = spark.createDataFrame([("s", days[6], 1.0)], "series_id string, date date, price double")
    got = merge.append_unique(files, stored)
    assert sorted({r["file_no"] for r in got.collect()}) == [1, 3, 7]
    assert got.count() == 6


def test_chain_of_conflicting_files_and_removed_work_tables(spark, tmp_path, monkeypatch):
    """File i shares a key with file i + 1; every second one gets in."""
    made = []
    monkeypatch.setattr(merge, "new_table_path", lambda spark, name: made.append(str(tmp_path / f"{len(made)}-{name}")) or made[-1])
    day = dt.date(2020, 1, 1)
    rows = [(i, "s", day + dt.timedelta(days=i + k), 1.0) for i in range(12) for k in (0, 1)]
    rows += [(100 + i, "other", day + dt.timedelta(days=i), 1.0) for i in range(5)]
    rows += [(200, "twice", day, 1.0), (200, "twice", day, 2.0), (201, "held", day, 1.0)]
    files = spark.createDataFrame(rows, "file_no int, series_id string, date date, price double")
    held = files.filter("series_id = 'held'").drop("file_no")
    got = {r["file_no"] for r in merge.append_unique(files, held).select("file_no").distinct().collect()}
    assert got == {0, 2, 4, 6, 8, 10} | {100, 101, 102, 103, 104}
    import os

    assert [os.path.basename(p).split("-", 1)[1] for p in made if os.path.exists(p)] == ["append-rejected"]
