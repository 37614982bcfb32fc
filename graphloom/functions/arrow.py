"""Series-to-series functions, for what Spark has no built-in of."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F


def series_udf(f: Callable[[pd.Series], pd.Series], returns: str):
    """A pandas UDF of one argument."""

    def run(x):
        return f(x)

    run.__annotations__ = {"x": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, returns)


def nfc(x: pd.Series) -> pd.Series:
    return x.str.normalize("NFC")
