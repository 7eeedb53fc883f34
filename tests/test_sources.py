"""Wide CSV files, sample metadata, bad samples, unique names, stages."""

import pytest
from pyspark.sql import functions as F

from stipple.sources import matrix_csv, regulons, stages

HEAD = "Gene,Cell1,Cell2,Cell3,Cell4\n"
GOOD = HEAD + "GeneA,12,0,0,10\nGeneB,5,3,0,8\nGeneC,0,0,0,2\nGeneB,9,7,0,0\nGeneB-1,1,0,0,0\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "96_6_M_KO_qc_norm.csv").write_text(GOOD)
    (tmp_path / "100_3_F_WT_qc_norm.csv").write_text(HEAD + "GeneD,1,2,3,4\n")
    return tmp_path


def test_counts_and_fields(spark, folder):
    got = {(r.sample, r.sex, r.condition, r.cell_id, r.gene): r.n
           for r in matrix_csv.read_counts(spark, str(folder)).collect()}
    ko = ("96_6_M_KO", "M", "KO")
    assert got[(*ko, "Cell1", "GeneA")] == 12 and got[(*ko, "Cell4", "GeneA")] == 10
    assert (*ko, "Cell2", "GeneA") not in got
    # the second GeneB may not take GeneB-1, which exists
    assert got[(*ko, "Cell1", "GeneB")] == 5 and got[(*ko, "Cell1", "GeneB-2")] == 9
    assert got[(*ko, "Cell1", "GeneB-1")] == 1
    assert got[("100_3_F_WT", "F", "WT", "Cell3", "GeneD")] == 3 and len(got) == 13


def test_cell_names_that_look_like_numbers(spark, tmp_path):
    names = [str(i) for i in range(40)]
    (tmp_path / "5_1_M_KO_qc_norm.csv").write_text("Gene, " + ",".join(names) + "\nG1" + ",1" * 40 + "\n")
    counts, cells, _ = matrix_csv.read_samples(spark, str(tmp_path))
    assert sorted(r.cell_id for r in cells.collect()) == sorted(r.cell_id for r in counts.collect()) == sorted(names)


@pytest.mark.parametrize("line,reason", [
    ("GeneX,1,2,3\n", "ragged row"), ("GeneX,1,x,3,4\n", "not a number"),
    ("GeneX,1,-2,3,4\n", "negative count"), (",1,2,3,4\n", "empty gene")])
def test_bad_samples_are_set_aside(spark, folder, line, reason):
    (folder / "7_1_F_KO_qc_norm.csv").write_text(GOOD + line)
    (folder / "oddname.csv").write_text(GOOD)
    counts, cells, bad = matrix_csv.read_samples(spark, str(folder))
    assert {(r.sample, r.reason) for r in bad.collect()} == {("7_1_F_KO", reason), ("oddname", "bad file name")}
    assert {r.sample for r in counts.select("sample").distinct().collect()} == {"96_6_M_KO", "100_3_F_WT"}
    assert cells.count() == 8
    with pytest.raises(Exception, match="bad line"):
        matrix_csv.read_counts(spark, str(folder / "7_1_F_KO_qc_norm.csv")).collect()


def test_make_unique_skips_existing(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a-1"), (4, "a"), (5, "b"), (6, "a-1")], "o bigint, n string")
    got = [r.u for r in matrix_csv.make_unique(df, "n", "o", "u").orderBy("o").collect()]
    assert got == ["a", "a-2", "a-1", "a-3", "b", "a-1-1"]


def test_regulons_and_missing_source(spark, tmp_path):
    wide = spark.createDataFrame([("g1", 1.0, 0.0), ("g2", 0.0, -1.0)], "gene string, T1 double, T2 double")
    wide.write.option("header", True).csv(str(tmp_path / "w"))
    got = regulons.read_regulon(spark, str(tmp_path / "w"), "db", layout="wide", fmt="csv", tfs=["T2"]).collect()
    assert [(r.tf, r.target, r.weight) for r in got] == [("T2", "g2", -1.0)]
    assert regulons.read_regulon(spark, str(tmp_path / "none"), "db").count() == 0


def test_reading_one_layer_prunes_files_and_columns(spark, tmp_path):
    df = spark.createDataFrame([("a", "c1", "g", 1.0), ("b", "c1", "g", 2.0)], "layer string, cell_id string, gene string, value double")
    stages.write_stage(str(tmp_path), "s", {"expr": df})
    one = stages.read_layer(spark, str(tmp_path), "s", "b")
    assert [tuple(r) for r in one.collect()] == [("c1", "g", 2.0)]
    assert {r.layer for r in stages.layers(spark, str(tmp_path), "s").collect()} == {"a", "b"}
