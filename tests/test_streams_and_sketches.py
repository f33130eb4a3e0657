"""Streams that stop and go on, late rows, and sketches that merge."""

from __future__ import annotations

import datetime as dt
import os
import time as clock

import pytest
from pyspark.sql import functions as F

from tallyfold.operators import sketches as K
from tallyfold.session import Session
from tallyfold.streaming import runs
from tallyfold.streaming import windows as W


def _at(minute):
    return dt.datetime(2024, 5, 1, 10) + dt.timedelta(minutes=minute)


def _put(spark, folder, name, rows):
    """One file of a folder, younger than those before it."""
    out = f"{folder}-{name}"
    spark.createDataFrame([(_at(m), k, v) for m, k, v in rows], "ts timestamp, k string, v double").coalesce(1).write.parquet(out)
    part = next(p for p in os.listdir(out) if p.endswith(".parquet"))
    os.makedirs(folder, exist_ok=True)
    target = os.path.join(folder, f"{name}.parquet")
    os.rename(os.path.join(out, part), target)
    age = clock.time() - 1000 + len(os.listdir(folder)) * 10
    os.utime(target, (age, age))


def test_late_rows_and_a_second_run(spark, tmp_path):
    folder, sink, point = str(tmp_path / "in"), str(tmp_path / "sink"), str(tmp_path / "point")
    run = lambda: sorted((r.start.hour, r.k, r.n, r.total) for r in runs.over(spark, folder, "ts", lambda r: W.tumbling(r, "ts", "1 hour", "10 minutes", ["k"], "v"), sink, point, 1).collect())
    _put(spark, folder, "a", [(5, "x", 1.0), (50, "x", 2.0), (55, "y", 4.0)])
    assert run() == []  # the watermark, 10:45, has passed no end
    _put(spark, folder, "b", [(58, "x", 8.0), (65, "x", 16.0)])  # a late row before the watermark's end counts
    _put(spark, folder, "c", [(75, "y", 32.0)])  # watermark 11:05: the first hour is final
    assert run() == [(10, "x", 3, 11.0), (10, "y", 1, 4.0)]
    _put(spark, folder, "d", [(20, "x", 64.0), (200, "x", 128.0)])  # 10:20 is too late, and is dropped
    assert run() == [(10, "x", 3, 11.0), (10, "y", 1, 4.0), (11, "x", 1, 16.0), (11, "y", 1, 32.0)]
    assert run() == [(10, "x", 3, 11.0), (10, "y", 1, 4.0), (11, "x", 1, 16.0), (11, "y", 1, 32.0)]  # nothing new, nothing twice


def test_null_times_and_empty_tables(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([(None, "x", 1.0), (_at(0), None, 2.0), (_at(300), "x", None)], "ts timestamp, k string, v double").write.parquet(folder)
    got = runs.over(spark, folder, "ts", lambda r: W.tumbling(r, "ts", "1 hour", "0 seconds", ["k"], "v")).collect()
    assert [(r.k, r.n, r.total) for r in got] == [(None, 1, 2.0)]
    empty = str(tmp_path / "empty")
    spark.createDataFrame([], "ts timestamp, k string, v double").write.parquet(empty)
    assert runs.over(spark, empty, "ts", lambda r: W.sessions(r, "ts", "1 hour", "0 seconds", ["k"])).count() == 0


def test_stream_command(spark, tmp_path):
    folder = str(tmp_path / "in")
    _put(spark, folder, "a", [(0, "x", 1.0), (10, "x", 2.0), (90, "x", 4.0), (400, "y", 8.0)])
    s = Session(spark)
    s.run(f"stream {folder} time(ts) gap(30 minutes) by(k)")
    assert sorted((r.k, r.n) for r in s.df.collect()) == [("x", 1), ("x", 2)]
    s.run(f"stream {folder} time(ts) width(2 hours) value(v) by(k)")
    assert [(r.k, r.n, r.total) for r in s.df.collect()] == [("x", 3, 7.0)]
    with pytest.raises(ValueError, match="not known"):
        s.run(f"stream {folder} time(ts) gap(30 minutes) nonsense(1)")


@pytest.fixture(scope="module")
def rows(spark):
    # a group that holds half of the rows, a small one, and null values
    return spark.range(40000).select(F.when(F.col("id") % 2 == 0, "big").otherwise(F.concat(F.lit("g"), F.col("id") % 5)).alias("g"), (F.col("id") % 7).alias("day"), (F.col("id") % 9000).alias("u"), F.when(F.col("id") % 10 != 3, F.col("id") / 3).alias("v"))


def test_sketches_merge_within_their_bounds(rows, tmp_path, spark):
    fine = K.sketched(rows, ["g", "day"], ["u"], ["v"])
    fine.write.parquet(str(tmp_path / "s"))
    for by in (["g"], []):
        got = {tuple(r[c] for c in by): r for r in K.estimated(K.merged(spark.read.parquet(str(tmp_path / "s")), by), [0.1, 0.5]).collect()}
        want = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct("u").alias("d"), F.sort_array(F.collect_list("v")).alias("vs")).collect()
        assert len(got) == len(want)
        for w in want:
            r = got[tuple(w[c] for c in by)]
            assert r.rows == w.n and abs(r.u_distinct / w.d - 1) < 5 * K.distinct_error()
            for q, x in ((0.1, r.v_q10), (0.5, r.v_q50)):
                share = sum(v <= x for v in w.vs) / len(w.vs) if w.vs else q
                assert (x is None) == (not w.vs) and abs(share - q) < 3 * K.rank_error() + 1 / max(len(w.vs), 1)


def test_sketch_edges(spark):
    odd = spark.createDataFrame([(None, None, None), ("a", float("nan"), 0.0), ("a", 2.0, -0.0)], "g string, v double, z double")
    got = {r.g: r for r in K.estimated(K.sketched(odd, ["g"], ["z"], ["v"]), [0.5]).collect()}
    assert (got["a"].z_distinct, got["a"].v_q50, got[None].z_distinct, got[None].v_q50) == (1, 2.0, 0, None)
    nothing = K.estimated(K.merged(K.sketched(odd.where("false"), ["g"], ["z"], ["v"])), [0.5]).collect()
    assert [(r.rows, r.v_q50) for r in nothing] == [(0, None)]
    for bad in (lambda: K.sketched(odd, ["g"]), lambda: K.merged(odd.withColumn("rows", F.lit(1)), ["g"]), lambda: K.estimated(odd, [1.5])):
        with pytest.raises(ValueError):
            bad()


def test_sketch_commands(rows, spark):
    s = Session(spark)
    s.use(rows)
    s.run("sketch distinct(u) quantiles(v) by(g day)")
    s.run("sketch merge by(g)")
    got = s.run("sketch estimate at(0.5)").collect()
    assert {r.g for r in got} == {"big", "g0", "g1", "g2", "g3", "g4"}
    s.use(rows)
    s.run("groupby g agg u:approx_nunique v:approx_median")
    assert s.df.columns == ["g", "u_approx_nunique", "v_approx_median"]
