import os
import sys

import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pricewatch import schemas  # noqa: E402
from pricewatch.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def price_frame(spark):
    """prices(values, start, series): a price panel of consecutive days; None keeps the row null."""

    def build(values, start="2020-01-01", series="s", skip_missing=False):
        days = pd.date_range(start, periods=len(values), freq="D").date
        rows = [
            (series, d, None if v is None else float(v))
            for d, v in zip(days, values)
            if not (skip_missing and v is None)
        ]
        return spark.createDataFrame(rows, schemas.PRICE_OBS)

    return build
