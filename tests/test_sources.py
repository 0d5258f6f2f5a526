import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from wearline import catalog
from wearline.operators import contracts, datasets, signal
from wearline.sources import snapshots, tables


def write(root, split, bearing, index, n=64, delimiter=",", kind="acc", extra=""):
    folder = os.path.join(root, split, bearing)
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, f"{kind}_{index:05d}.csv"), "w") as f:
        for i in range(n):
            row = [9, 0, 0, i, np.sin(2 * np.pi * i / 16) + 0.01 * index, np.cos(2 * np.pi * i / 13) + 0.02 * index] if kind == "acc" else [9, 0, i % 60, 0, 25.5]
            f.write(delimiter.join(f"{x:.8f}" if kind == "acc" else str(x) for x in row) + "\n")
        f.write(extra)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("raw"))
    for i in (1, 2, 3):
        write(root, "Learning_set", "Bearing1_1", i)
    for i in (1, 2):
        write(root, "Test_set", "Bearing1_3", i, delimiter=";", extra="\n")
    for i in (1, 2, 3, 4):
        write(root, "Full_Test_Set", "Bearing1_3", i)
    write(root, "Learning_set", "Bearing1_1", 1, 10, kind="temp")
    return root


def features(spark, root, split):
    rows = snapshots.vibration(spark, root).where(F.col("split") == split)
    return signal.snapshot_features(rows, ["split", "condition", "bearing", "file_index"])


def test_boundary_trio(spark, root):
    train = datasets.training_dataset(features(spark, root, "Training_set"))
    assert [r.rul_seconds for r in train.orderBy("file_index").collect()] == [20.0, 10.0, 0.0]
    assert train.columns == [*catalog.METADATA, *catalog.signal_columns(), *catalog.temporal_columns(), "rul_seconds"]
    test = datasets.test_feature_dataset(features(spark, root, "Test_set"))
    assert test.count() == 2 and "rul_seconds" not in test.columns
    truth = datasets.ground_truth(features(spark, root, "Test_set"), features(spark, root, "Validation_Set"))
    assert sorted(r.rul_seconds for r in truth.collect()) == [20.0, 30.0]
    assert contracts.key_differences(test, truth, ["condition", "bearing", "file_index"]).isEmpty()
    assert contracts.unfinished_runs(train).isEmpty()


def test_order_of_samples_is_that_of_the_file(spark, root):
    rows = snapshots.vibration(spark, root, "Learning_set").where("file_index = 2").orderBy("position").collect()
    assert [r.microsecond for r in rows] == list(range(64)) and rows[0].condition == 1


def test_both_delimiters_agree(spark, root):
    rows = contracts.prefix_differences(snapshots.vibration(spark, root, "Test_set"), snapshots.vibration(spark, root, "Full_Test_Set"), ["bearing", "file_index", "position"], ["horiz_accel_g", "vert_accel_g"]).first()
    assert (rows.n_rows, rows.n_missing, rows.n_different) == (128, 0, 0)


def test_temperature_and_its_absence(spark, root):
    assert snapshots.temperature(spark, root, "Learning_set").count() == 10
    empty = snapshots.temperature(spark, root, "Test_set")
    assert empty.count() == 0 and "temperature_c" in empty.columns


def test_listing_and_inventory(spark, root):
    files = snapshots.listing(spark, root)
    assert [r.file_index for r in snapshots.files_of(spark, root, "acc").where("split = 'Validation_Set'").collect()] == [1, 2, 3, 4]
    assert snapshots.bearings(spark, root).count() == 3
    with pytest.raises(ValueError):
        snapshots.bearings(spark, root, "none")
    row = {(r.split): r for r in snapshots.inventory(snapshots.lines_of(spark, root, "acc"), files).collect()}
    assert (row["Training_set"].n_acc, row["Training_set"].n_temp, row["Test_set"].delimiter) == (3, 1, ";")
    assert snapshots.fingerprints(spark, f"{root}/Learning_set/*/*").count() == 4


def test_faults_of_raw_files(spark, tmp_path):
    root = str(tmp_path)
    write(root, "Test_set", "Bearing1_1", 1, 2560)
    write(root, "Test_set", "Bearing1_1", 3, 2560, extra="1,2,3\n")
    write(root, "Test_set", "Bearing1_1", 1, 5, kind="temp")
    write(root, "Test_set", "Bearing9_1", 1, kind="temp")
    os.makedirs(f"{root}/Test_set/Bearing1_2")
    with open(f"{root}/Test_set/Bearing1_2/notes.txt", "w") as f:
        f.write("x")  # Spark lists no empty files
    found = {(r.bearing, r.problem, r.severity) for r in contracts.directory_faults(snapshots.listing(spark, root)).collect()}
    assert ("Bearing1_1", "gap in vibration files", "CRITICAL") in found and ("Bearing1_2", "stray file", "WARNING") in found
    assert ("Bearing9_1", "unknown condition", "CRITICAL") in found and ("Bearing9_1", "no vibration files", "CRITICAL") in found
    lines = snapshots.lines_of(spark, root, "acc").unionByName(snapshots.lines_of(spark, root, "temp"))
    bad = {(r.bearing, r.kind, r.file_index): r.severity for r in contracts.shape_faults(contracts.file_shapes(lines)).collect()}
    assert bad == {("Bearing1_1", "acc", 3): "CRITICAL", ("Bearing1_1", "temp", 1): "WARNING", ("Bearing9_1", "temp", 1): "WARNING"}
    assert contracts.delimiter_summary(contracts.file_shapes(lines)).count() == 3


def test_unparsable_values(spark, tmp_path):
    root = str(tmp_path)
    write(root, "Test_set", "Bearing1_1", 1, 2, extra="1,2,3,4,bad,6\n")
    assert snapshots.vibration(spark, root, lenient=True).where("horiz_accel_g IS NULL").count() == 1
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cast"):
        snapshots.vibration(spark, root).collect()


def test_bad_names_fail(spark):
    df = spark.createDataFrame([("/a/Test_set/Nope/acc_1.csv",)], "p string")
    with pytest.raises(Exception, match="not a bearing directory"):
        df.select(snapshots.located(F.col("p"))["condition"]).collect()
    with pytest.raises(Exception, match="no file index"):
        df.select(snapshots.file_number(F.lit("/a/acc.csv"))).collect()


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("s", "b", i, float(i)) for i in range(3)], "split string, bearing string, file_index int, x double")
    tables.write_table(df, f"{tmp_path}/t")
    assert tables.read_columns(spark, f"{tmp_path}/t", ["x"]).columns == ["x"]
    with pytest.raises(contracts.ContractError):
        tables.read_columns(spark, f"{tmp_path}/t", ["y"])
    tables.write_csv(df, f"{tmp_path}/c")
    tables.write_json(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 3
    catalog.write_feature_schema(spark, f"{tmp_path}/schema")
    assert "rul_seconds" in spark.read.text(f"{tmp_path}/schema").first()[0]
    tables.publish(df, "published")
    tables.publish(df.limit(2), "published")
    assert spark.table("published").count() == 2
    with pytest.raises(contracts.ContractError):
        tables.publish(df.union(df), "published")
    with pytest.raises(contracts.ContractError):
        tables.publish(df.where("false"), "published")
    assert [r.file_index for r in tables.stored_features(df, "s", "v1").collect()] == [0, 1, 2]
