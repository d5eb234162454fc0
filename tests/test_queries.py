"""Every query of the engine against its SQL on the smallest tables."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from gatewright.plans import registry
from tests.compare import duck_rows, spark_rows

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, name):
    assert spark_rows(registry.QUERIES[name](spark, SF_DIR)) == duck_rows(registry.ORACLE_SQL[name], SF_DIR)


#: Queries that test_operators.py compares with brute force or with what they must beat.
ELSEWHERE = {"q090_clause_pick", "q091_reader_pick", "q206_bca_bootstrap", "q217_clopper_pearson", "q219_mcnemar_chi2", "q222_tango", "q260_router_gate", "q263_class_router", "q279_units", "q284_text_classifier"}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL) - ELSEWHERE))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, SF_DIR)
    assert df.columns and df.count() > 0


def test_containment_is_of_the_whole_item(spark, tmp_path):
    """A document that shares only an item's opening doesn't hold it."""
    item = " ".join(f"word{i}" for i in range(30))
    spark.createDataFrame([(1, item), (2, "short item")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, f"before {item} after"), (2, item[:80] + " and another end"), (3, None), (4, "none")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["q152_containment"](spark, str(tmp_path)).collect()
    assert {r["item_id"]: r["holders"] for r in got} == {1: 1, 2: 0}


def test_order_headroom_shuffles_texts_and_not_bigrams(spark, tmp_path):
    """Rows of one id count together, ids without a bigram have no row; nothing is exploded."""
    rows = [(1, "a b a"), (1, "b a  a"), (2, "x x x"), (3, "one"), (4, None), (5, "A b"), (None, "a b c"), (None, "c b")]
    pq.write_table(pa.table([list(c) for c in zip(*rows, strict=True)], names=["doc_id", "text"]), f"{tmp_path}/documents.parquet")
    df = registry.QUERIES["q295_order_headroom"](spark, str(tmp_path))
    assert spark_rows(df) == duck_rows(registry.ORACLE_SQL["q295_order_headroom"], str(tmp_path))
    assert "Generate" not in df._jdf.queryExecution().executedPlan().toString()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
