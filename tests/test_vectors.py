"""Nearest vectors by blocks against SQL, with copies and odd vectors."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from gatewright.operators import vectors as v
from gatewright.plans import registry
from tests.compare import duck_rows, spark_rows


@pytest.mark.parametrize("name", ["q084_nearest", "q085_nearest_with_ties", "q086_rerank", "q088_novelty", "q317_incremental_novelty", "q274_dynamic_selection"])
def test_blocks_match_sql_on_odd_vectors(spark, tmp_path, monkeypatch, name):
    """Zero vectors, infinite components and nulls among them, and more copies than neighbours are asked for."""
    monkeypatch.setattr(v, "CORPUS_BLOCK", 150)
    monkeypatch.setattr(v, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 6)).round(1)
    x[50:90] = x[100]
    rows = [(i, i % 10, [float(e) for e in r]) for i, r in enumerate(x)]
    if name in ("q084_nearest", "q085_nearest_with_ties", "q088_novelty"):
        rows += [(1000, 1, None), (1001, 1, None)]
    rows += [(1100, 2, [0.0] * 6), (1103, 2, [0.0] * 6)]
    kinds = pa.schema([("vec_id", pa.int64()), ("label", pa.int32()), ("embedding", pa.list_(pa.float32()))])
    pq.write_table(pa.table([list(c) for c in zip(*rows, strict=True)], schema=kinds), f"{tmp_path}/embeddings.parquet")
    assert spark_rows(registry.QUERIES[name](spark, str(tmp_path))) == duck_rows(registry.ORACLE_SQL[name], str(tmp_path))
