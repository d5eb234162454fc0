"""Functions by name in a session: expressions as SQL functions, an aggregate and a table function for queries in SQL."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

#: Name -> (arguments, result type, body) of SQL functions that Catalyst inlines: no Python runs.
SCALARS = {
    "gw_normalize_label": ("x STRING", "STRING", "lower(trim(x))"),
    "gw_dedup_form": ("x STRING", "STRING", r"regexp_replace(regexp_replace(trim(regexp_replace(lower(x), '\\s+', ' ')), '\\s+([,.!?;:])', '$1'), '[.!]+$', '')"),
    "gw_wilson_low": ("k DOUBLE, n DOUBLE", "DOUBLE", "greatest((k / n + 1.9207294103470622D / n - 1.959963984540054D * sqrt((k / n) * (1 - k / n) / n + 0.9603647051735311D / (n * n))) / (1 + 3.8414588206941245D / n), 0D)"),
}


def _kish(w: pd.Series) -> float:
    return float(w.sum() ** 2 / (w**2).sum()) if (w**2).sum() else 0.0


class _Sentences:
    """Rows (position, sentence) of a text."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        n = 0
        for part in re.split(r"[.!?;\n]", text or ""):
            if part := part.strip(" "):
                yield n, part
                n += 1


def register_all(spark: SparkSession) -> list[str]:
    """Registers every function for the session; returns their names."""
    for name, (args, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    kish = F.pandas_udf("double")(_typed(_kish))
    spark.udf.register("gw_kish_n", kish)
    spark.udtf.register("gw_sentences", udtf(_Sentences, returnType="position int, sentence string"))
    return [*SCALARS, "gw_kish_n", "gw_sentences"]


def _typed(fn):
    """The annotations by which Spark knows a grouped aggregate, as types and not as text."""
    fn.__annotations__ = {"w": pd.Series, "return": float}
    return fn
