"""Sources and incoming rows on cases made by hand."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stepfree.operators import intake
from stepfree.sources import tables


def test_fnv1a_follows_its_definition():
    expected = intake.FNV_START
    for byte in (1, 0, 0, 0, 0, 0, 0, 0, 255, 255, 255, 255, 255, 255, 255, 255):
        expected = ((expected ^ byte) * intake.FNV_PRIME) & (2**64 - 1)
    assert intake.fnv1a.func(pd.Series([[1, -1], []])).tolist() == [f"{expected:016x}", f"{intake.FNV_START:016x}"]


def test_coordinates_that_are_not_finite_or_not_there(spark):
    bodies = ['{"X": 1.5, "y": 2}', '{"x": "NaN", "y": 1}', '{"x": "a", "y": 1}', "[3]", "not json", "", None, '{"type":"Point","coordinates":[7,8,9]}', '{"x": 1e999, "y": 1}']
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    x = [r[0] for r in df.select(intake.json_number(F.col("body"), "$.x", "$.coordinates[0]", "$[0]")).collect()]
    assert x == [1.5, None, None, 3.0, None, None, None, 7.0, None]


def test_csv_and_json_keep_texts(spark):
    rows = [(1, 'a "quoted", text', 1.5, 2), (2, "", -0.25, 2), (3, None, None, 3), (4, "Köln, 1", 0.0, 3)]
    df = spark.createDataFrame(rows, "id long, name string, balance double, place long")
    folder = tables.work_folder(spark)
    tables.write_csv(df, folder)
    assert sorted(map(tuple, tables.read_csv(spark, folder, "id long, name string, balance double, place long").collect())) == rows
    folder = tables.work_folder(spark)
    tables.write_jsonl(df, folder, "place")
    back = tables.read_jsonl(spark, folder, "id long, name string, balance double, place long")
    assert sorted(map(tuple, back.select("id", "name", "balance", "place").collect())) == rows


def test_missing_files_are_skipped_but_not_all(spark):
    folder = tables.work_folder(spark)
    spark.range(3).write.parquet(f"{folder}/a")
    assert tables.read_many(spark, f"{folder}/a;{folder}/b; ;").count() == 3
    with pytest.raises(FileNotFoundError):
        tables.read_many(spark, f"{folder}/b;")
