"""File sources and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from minim.sources import files
from minim.sources.releases import load_release, release_points, save_release
from minim.spec import DatasetSpec, get_spec
import minim.datasets  # noqa: F401

SPEC = DatasetSpec(name="t", features=("age", "job"), qis=("age", "job"), numeric=("age",), label="y", string_categories=("job",))


def test_labelled_csv_with_mark(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text('﻿"age";"job";"y"\n30;"admin";"no"\nx;"tech";"yes"\n', encoding="utf-8")
    rows = files.read_labelled_csv(spark, str(path), SPEC).orderBy("row_id").collect()
    assert [(r["row_id"], r["age"], r["job"], r["y"]) for r in rows] == [(0, 30.0, "admin", "no"), (1, None, "tech", "yes")]
    bad = tmp_path / "bad.csv"
    bad.write_text("age;y\n1;no\n")
    with pytest.raises(ValueError, match="missing"):
        files.read_labelled_csv(spark, str(bad), SPEC)


def test_xy_by_position_and_key(spark, tmp_path):
    x, y = tmp_path / "x.csv", tmp_path / "y.csv"
    x.write_text("id,age,job\n7,1,a\n8,2,b\n")
    y.write_text("id,y\n8,1\n7,0\n")
    by_key = files.read_xy(spark, str(x), str(y), SPEC, key="id").collect()
    assert {(r["age"], r["y"]) for r in by_key} == {(1.0, "0"), (2.0, "1")}
    by_line = files.read_xy(spark, str(x), str(y), SPEC).collect()
    assert {(r["age"], r["y"]) for r in by_line} == {(1.0, "1"), (2.0, "0")}


def test_arff(spark, tmp_path):
    path = tmp_path / "d.arff"
    path.write_text("% note\n@relation r\n@attribute 'credit amount' numeric\n@attribute purpose {a,'b c'}\n@data\n12,'b c'\n% note\n?,@data\n% end\n")
    df = files.read_arff(spark, str(path))
    assert df.columns == ["credit amount", "purpose", "row_id"]
    assert {tuple(r) for r in df.collect()} == {(12.0, "b c", 0), (None, "@data", 1)}
    path.write_text("@relation r\n@attribute a numeric\n1\n")
    with pytest.raises(ValueError, match="@data"):
        files.read_arff(spark, str(path))


def test_xy_over_files_of_unequal_size(spark, tmp_path):
    """Spark deals the largest file first; positions follow names."""
    for side in ("x", "y"):
        (tmp_path / side).mkdir()
    at = 0
    for i, n in enumerate((5, 900, 40, 1)):
        rows = range(at, at + n)
        (tmp_path / "x" / f"{i}.csv").write_text("age,job\n" + "".join(f"{r},j{r}\n" for r in rows))
        (tmp_path / "y" / f"{i}.csv").write_text("y\n" + "".join(f"{r}\n" for r in rows))
        at += n
    out = files.read_xy(spark, str(tmp_path / "x"), str(tmp_path / "y"), SPEC).collect()
    assert sorted(r["row_id"] for r in out) == list(range(at))
    assert all(r["age"] == r["row_id"] == float(r["y"]) for r in out)
    (tmp_path / "y" / "1.csv").write_text("y\n1\n")
    with pytest.raises(ValueError, match="pair"):
        files.read_xy(spark, str(tmp_path / "x"), str(tmp_path / "y"), SPEC)


def test_results(spark, tmp_path):
    csv, lines, js = tmp_path / "a.csv", tmp_path / "b.jsonl", tmp_path / "c.json"
    csv.write_text("method,k\nm,3\n")
    lines.write_text('{"method": "n", "k": "4"}\n')
    js.write_text(json.dumps([{"method": "o", "k": "5"}]))
    got = files.read_results(spark, [str(csv), str(lines), str(js)])
    assert {(r["method"], r["k"]) for r in got.collect()} == {("m", "3"), ("n", "4"), ("o", "5")}
    csv.write_text("method,method\n1,2\n")
    with pytest.raises(ValueError, match="duplicate"):
        files.read_results(spark, [str(csv)])
    csv.write_text("method,\n1,2\n")
    with pytest.raises(ValueError, match="empty"):
        files.read_results(spark, [str(csv)])


def test_sinks(spark, tmp_path):
    df = spark.range(3).withColumn("t", F.lit("x"))
    for fmt in ("parquet", "csv", "json"):
        files.write_rows(df, str(tmp_path / fmt), fmt)
        with pytest.raises(Exception):
            files.write_rows(df, str(tmp_path / fmt), fmt)
    files.write_rows(df, str(tmp_path / "log"), "jsonl")
    files.write_rows(df, str(tmp_path / "log"), "jsonl")
    assert spark.read.json(str(tmp_path / "log")).count() == 6


def test_hierarchy_file(spark, tmp_path):
    path = tmp_path / "trees.json"
    nodes = [{"id": "r", "parent": None}, {"id": "lo", "parent": "r", "value": "0 ~ 4"}, {"id": "hi", "parent": "r", "value": "5 ~ 9"}]
    jobs = [{"id": "j", "parent": None}, {"id": "a", "parent": "j", "value": "a"}]
    path.write_text(json.dumps({"trees": {"age": {"nodes": nodes}, "job": {"nodes": jobs}}}))
    table, forest = files.read_hierarchies(spark, str(path), SPEC)
    assert table.count() == 5 and forest["age"].height == 1 and forest["age"].numeric_value("r") == 4.5
    with pytest.raises(KeyError):
        files.read_hierarchies(spark, str(path), DatasetSpec(name="u", features=("z",), qis=("z",)))


def test_saved_releases(spark, tmp_path):
    path = str(tmp_path / "rel")
    for it in (0, 1):
        save_release(spark.createDataFrame([(1, it), (2, it)], "row_id int, snapshot int"), path, it)
    assert {r["snapshot"] for r in load_release(spark, path).collect()} == {1}
    assert {r["snapshot"] for r in load_release(spark, path, 0).collect()} == {0}
    saved = spark.read.parquet(path)
    assert [r[0] for r in release_points(saved, "final").collect()] == [1]
    assert sorted(r[0] for r in release_points(saved, [0, 1]).collect()) == [0, 1]
    with pytest.raises(Exception, match="no such iteration"):
        release_points(saved, [5]).collect()


def test_registry():
    assert get_spec("Bank").name == "bm" and len(get_spec("diabetes").qis) == 18
    with pytest.raises(KeyError):
        get_spec("nothing")
