"""Fixed schemas; nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


PRICE_OBS = _struct(
    ("series_id", T.StringType()),
    ("date", T.DateType()),
    ("price", T.DoubleType()),
)

FORECAST = _struct(
    ("series_id", T.StringType()),
    ("horizon", T.StringType()),
    ("model", T.StringType()),
    ("step", T.IntegerType()),
    ("forecast_date", T.DateType()),
    ("yhat", T.DoubleType()),
    ("yhat_lower", T.DoubleType()),
    ("yhat_upper", T.DoubleType()),
)

RISK_STATUS = _struct(
    ("series_id", T.StringType()),
    ("date", T.DateType()),
    ("horizon", T.StringType()),
    ("risk_score", T.IntegerType()),
    ("risk_level", T.StringType()),
    ("direction", T.StringType()),
    ("fdi_value", T.DoubleType()),
    ("vol_ratio", T.DoubleType()),
    ("trend_slope", T.DoubleType()),
    ("risk_message", T.StringType()),
    ("created_at", T.TimestampType()),
    ("row_no", T.LongType()),
)

#: Price table: rows keep their write order, files are partitioned by year.
PRICE_TABLE = _struct(
    ("series_id", T.StringType()),
    ("date", T.DateType()),
    ("price", T.DoubleType()),
    ("batch_no", T.IntegerType()),
    ("row_no", T.LongType()),
    ("year", T.IntegerType()),
)

MODEL_PARAMS = _struct(
    ("series_id", T.StringType()),
    ("scope", T.StringType()),
    ("model", T.StringType()),
    ("horizon", T.StringType()),
    ("anchor_date", T.DateType()),
    ("input_digest", T.LongType()),
    ("params", T.ArrayType(T.DoubleType())),
    ("fitted_at", T.TimestampType()),
)

TABLES = {
    "price_obs": PRICE_TABLE,
    "forecast": FORECAST,
    "risk_status": RISK_STATUS,
    "model_params": MODEL_PARAMS,
}

#: Partition columns of the stored tables; others have none.
PARTITIONS = {"price_obs": ("year",), "forecast": ("horizon",)}


def raw_sheet(width: int) -> T.StructType:
    """A sheet read without a header: ``width`` text cells per row."""
    return T.StructType(
        [T.StructField(f"c{i}", T.StringType()) for i in range(width)]
    )
