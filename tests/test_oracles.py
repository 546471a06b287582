"""Every registered query with a DuckDB statement gives the same rows."""
import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, differences
from tests.conftest import SF

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert 0 < len(rows) <= 20


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert differences(got, con.execute(ORACLES[name]).df()) is None


# Fits, draws and searches whose numbers SQL cannot give.
WITHOUT_SQL = set("""route_columns similarity_encoder_strings pca_scores nystroem group_lasso_selection recursive_elimination sequential_selection recursive_addition
pca_then_select isolation_forest cblof mcd score_union adasyn_oversampling borderline_oversampling kmeans_oversampling svm_oversampling borderline_oversampling_kind_2 smote_enn
smote_tomek sampler_chain calibration best_boosting_stage score_table fit_and_predict client_clusters client_clusters_tree feature_table prequential_grid_search time_series_cross_validation
stratified_kfold_report workflow_fit_score card_topk_remove_detected performance_assessment""".split())


def test_catalog_queries_have_oracles_or_are_named_here():
    from catalog import ORACLES as sql, QUERIES as own
    rest = {n for n in own if n not in sql and not n.startswith("classifier_")}
    assert rest <= WITHOUT_SQL and not WITHOUT_SQL & set(sql)


def test_daily_folders_prune_files(spark, tmp_path, tx):
    from txrisk.sources import io
    io.write_daily(tx.select("TRANSACTION_ID", "TX_DATETIME"), str(tmp_path / "d"))
    plan = io.read_date_range(spark, str(tmp_path / "d"), "2024-01-03", "2024-01-05")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tx_date" in plan
