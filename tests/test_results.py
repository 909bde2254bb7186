"""Result files, checkpoints, and micro-batches of edits."""

import zipfile

import pytest
from pyspark.sql import functions as F

from verdigraph import runtime
from verdigraph.functions import algebra
from verdigraph.sources import codecs, results
from verdigraph.streaming.edits import Engine

ROWS = [(1, "p", "nonModifyingMethod", "false", "a"), (2, "p", "immutable", "false", "a"), (3, "q", "immutable", "3", "b"), (4, "q", "immutable", None, "b")]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, results.SCHEMA)


def keys(df):
    return sorted((r.elem_id, r.key, r.value) for r in df.collect())


KEPT = [(1, "nonModifyingMethod", "false"), (3, "immutable", "3")]


def test_json_round_trip(spark, rows, tmp_path):
    assert results.write_json(rows.union(spark.createDataFrame([(None, "p", "k", "v", "a")], results.SCHEMA)), str(tmp_path / "r")) == 1
    got = results.read_json(spark, [str(tmp_path / "r")])
    assert keys(got.rows) == KEPT and got.skipped == 0
    files = [f.read_text().splitlines() for f in (tmp_path / "r").glob("part-*")]
    assert all(lines[0] == '{"format": "verdigraph-results", "version": 1}' for lines in files if lines) and any(files)
    assert keys(results.read_json(spark, [str(tmp_path / "r")], keys=["immutable"]).rows) == KEPT[1:]
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        for f in (tmp_path / "r").glob("part-*"):
            z.write(f, f.name)
    assert keys(results.read_archive(spark, str(tmp_path / "r.zip"), str(tmp_path / "un")).rows) == KEPT


def test_versions_and_broken_lines(spark):
    good = '{"elem_id":1,"package":"p","key":"k","value":"v","origin":"a"}'
    assert results.read_string(spark, good).rows.count() == 1  # unmarked: version 0
    with pytest.raises(results.UnknownVersion):
        results.read_string(spark, '{"format":"verdigraph-results","version":2}\n' + good)
    with pytest.raises(ValueError, match="1 result lines"):
        results.read_string(spark, good + "\nnot json")
    got = results.read_string(spark, good + "\nnot json\n{}", strict=False)
    assert got.rows.count() == 1 and got.skipped == 2


def test_parquet_prunes_keys_and_packages(spark, rows, tmp_path):
    results.write_parquet(rows, str(tmp_path / "p"))
    got = results.read_parquet(spark, str(tmp_path / "p"), ["immutable"])
    assert keys(got) == KEPT[1:]
    plan = got.where("package = 'q'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(package" in plan and "PushedFilters: [IsNotNull(key), EqualTo(key,immutable)" in plan


def test_restore_and_checkpoints(spark, rows, tmp_path):
    loaded = spark.createDataFrame([(1, "p", "nonModifyingMethod", "true", "x"), (9, "p", "k", "v", "x")], results.SCHEMA)
    assert keys(results.restore(rows.where("elem_id = 1"), loaded)) == [(1, "nonModifyingMethod", "false"), (9, "k", "v")]
    points = results.Checkpoints(spark, runtime.fresh_path(spark, "points"))
    points.pass_completed(1, rows)
    points.pass_completed(2, loaded)
    assert (1, "nonModifyingMethod", "true") in keys(points.read()) and points.read().count() == 5
    points.clear()


def test_incremental_state(spark, tmp_path):
    state = results.IncrementalState(spark, str(tmp_path / "s"))
    fp = lambda *rows: spark.createDataFrame(rows, "node long, fp string")
    state.save(fp((1, "a"), (2, "b")), spark.createDataFrame([(1, 2)], "consumed long, consumer long"))
    assert {r.node for r in state.changed(fp((1, "a"), (2, "c"), (3, "d"))).collect()} == {2, 3}


def test_streamed_edits_equal_one_batch(spark, tmp_path):
    """User nodes take the sum of what they use; edits come as files, one micro-batch or several."""
    depends = spark.createDataFrame([(2, 1), (3, 2), (5, 4)], "user long, used long")
    prior = spark.createDataFrame([(k, "old") for k in range(1, 6)], "node long, fp string")
    recompute = lambda df: df.select("node", F.concat(F.lit("new"), F.col("node")).alias("fp"))
    edits = spark.createDataFrame([(1, "e"), (4, "old")], "node long, fp string")
    edits.write.parquet(str(tmp_path / "edits"))
    heard = []
    engine = Engine(prior, depends, recompute, [lambda n, df: heard.append(sorted(r.node for r in df.collect()))])
    engine.start(spark.readStream.schema("node long, fp string").parquet(str(tmp_path / "edits")), str(tmp_path / "cp")).awaitTermination(120)
    assert heard == [[1, 2, 3]]
    assert {r.node: r.fp for r in engine.state().collect()} == {1: "e", 2: "new2", 3: "new3", 4: "old", 5: "old"}
    assert Engine(prior, depends, recompute).apply(edits).count() == 3


def test_the_last_edit_counts_and_a_restart_goes_on(spark, tmp_path):
    depends = spark.createDataFrame([(2, 1)], "user long, used long")
    prior = spark.createDataFrame([(1, 0), (2, 0)], "node long, fp long")
    recompute = lambda df: df.select("node", (F.col("node") * 100).alias("fp"))
    edits = spark.createDataFrame([(1, 9, 1), (1, 7, 2)], "node long, fp long, seq long")
    make = lambda: Engine(prior, depends, recompute, folder=str(tmp_path / "states"))
    assert {tuple(r) for r in make().apply(edits, 0).collect()} == {(1, 7), (2, 200)}
    again = make()
    assert {tuple(r) for r in again.state().collect()} == {(1, 7), (2, 200)}
    assert again.apply(edits, 0).count() == 2  # a replay starts from the state before its batch
    assert again.apply(spark.createDataFrame([(1, 7, 3)], edits.schema), 1).count() == 0
    assert {tuple(r) for r in make().state().collect()} == {(1, 7), (2, 200)}


def test_links_and_values_come_back_from_result_files(spark, tmp_path):
    made = [(k % 3, "p", -k, k, 2 * k, "o") for k in range(1, len(algebra.NATURES) + 1)]
    schema = "m long, package string, src long, nature int, dst long, origin string"
    results.write_json(codecs.encode_links(spark.createDataFrame([*made, (9, "p", None, 1, 2, "o"), (9, "p", 1, None, 2, "o")], schema)), str(tmp_path / "l"))
    back = codecs.decode_links(results.read_json(spark, [str(tmp_path / "l")]).rows)
    assert sorted(tuple(r) for r in back.collect()) == sorted(made)
    for wrong in ("1 ? 2", "1 ≡", "x ≡ 2", ""):
        with pytest.raises(Exception, match="no link"):
            codecs.decode_links(spark.createDataFrame([(1, "p", "link", wrong, "o")], results.SCHEMA)).collect()
    df = spark.createDataFrame([(True, 3, "a b", [3, 1, 3]), (False, 0, "", []), (None, None, None, None)], "bool boolean, level int, text string, `set` array<int>")
    twice = df.select(*(codecs.decode_value(codecs.encode_value(F.col(k), k), k).alias(k) for k in df.columns))
    assert [tuple(r) for r in twice.collect()] == [(True, 3, "a b", [1, 3]), (False, 0, "", []), (None, None, None, None)]
