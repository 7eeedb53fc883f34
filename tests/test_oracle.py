"""A handful of registered queries against their SQL at the smallest scale;
``check_oracle.py`` runs all of them."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
check = pytest.importorskip("check_oracle")

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [
    "qc_cells", "make_unique", "shifted_log", "binomial_deviance", "hvg", "score_genes", "rank_genes",
    "marker_summary", "tf_shift_by_cluster", "welch", "knn", "silhouette", "paga_by_condition", "energy_distance"])
def test_query_equals_sql(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    assert check.compare(spark, check.connect(SF), SF, name).startswith("ok")


def test_every_query_is_named_once_and_sql_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
