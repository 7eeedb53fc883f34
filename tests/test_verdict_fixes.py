import pytest

from stipple.operators.score import unique_top
from stipple.sources import matrix_csv, regulons, stages


def test_clusters_are_served_in_number_order(spark):
    rows = [(str(c), r, f"g{g}") for c in range(12) for r, g in enumerate([0, c, c + 100], 1)] + [("other", 1, "g0"), ("other", 2, "g200")]
    got = {r.cluster: r.gene for r in unique_top(spark.createDataFrame(rows, "cluster string, rank int, gene string")).collect()}
    assert got == {"0": "g0", **{str(c): f"g{c}" for c in range(1, 12)}, "other": "g200"}


def test_folder_reader_stops_at_bad_values(spark, tmp_path):
    folder = tmp_path / "f=s_1_M_WT_qc_norm.csv"
    folder.mkdir()
    (folder / "part-0").write_text("Gene,c1,c2\ng1,5,x\n")
    with pytest.raises(Exception, match="not a number"):
        matrix_csv.read_counts(spark, str(tmp_path), folder="f").collect()


def test_other_conditions_can_be_named(spark, tmp_path):
    (tmp_path / "s_1_M_OLD_qc_norm.csv").write_text("Gene,c1,c2\ng1,5,2\n")
    path = str(tmp_path / "*.csv")
    assert matrix_csv.quarantine(spark, path).count() == 1
    assert matrix_csv.quarantine(spark, path, conditions=("OLD", "YOUNG")).count() == 0


def test_layer_names_may_hold_quotes(spark, tmp_path):
    df = spark.createDataFrame([("it's", "c", "g", 1.0), ("b", "c", "g", 2.0)], "layer string, cell_id string, gene string, value double")
    stages.write_stage(str(tmp_path), "s", {"expr": df})
    assert [r.value for r in stages.read_layer(spark, str(tmp_path), "s", "it's").collect()] == [1.0]


def test_only_an_absent_regulon_is_empty(spark, tmp_path):
    assert regulons.read_regulon(spark, str(tmp_path / "none"), "db").count() == 0
    with pytest.raises(Exception, match="[Dd]ata source"):
        regulons.read_regulon(spark, str(tmp_path), "db", fmt="no_such_format")
