"""The session and its command line."""

from __future__ import annotations

import pytest

from tallyfold.session import COMMANDS, Session
from tallyfold.sources.files import json_rows, labels_of, value_labels

SF = "/root/testdata/sf0.001"


def test_script(spark, tmp_path):
    s = Session(spark)
    s.script(f"""
    # a report
    load {SF}/lineitem.parquet
    filter l_quantity > 10
    derive net = l_extendedprice * (1 - l_discount)
    groupby l_returnflag agg net:sum l_quantity:mean
    """)
    assert s.df.columns == ["l_returnflag", "net_sum", "l_quantity_mean"]
    assert s.undo().count() > 100
    s.run("ols l_extendedprice ~ l_quantity, robust")
    assert [r.term for r in s.result.collect()] == ["const", "l_quantity"]
    s.run("predict yhat")
    s.run("summarize l_quantity yhat")
    assert s.result.count() == 2
    s.script("foreach v in l_tax l_discount {\nsummarize {v}\n}")
    assert s.result.first().variable == "l_discount"
    s.run("lag l_tax n=2 into(t2)")
    assert s.df.where("t2 is null").count() == 2
    s.run('sql "SELECT count(*) AS n FROM data"')
    assert s.df.first().n > 0
    s.run(f"save {tmp_path}/out.csv")
    s.run(f"load {tmp_path}/out.csv")
    assert dict(s.df.dtypes) == {"n": "bigint"}
    with pytest.raises(ValueError):
        s.run("nosuch x")
    assert len(COMMANDS) > 120


def test_json_and_labels(spark):
    assert json_rows({"data": {"items": [{"a": 1}, 2]}}, "data.items") == [{"a": 1}, {"value": 2}]
    df = value_labels(spark.createDataFrame([(1,)], "g long"), "g", {1: "Male"})
    assert labels_of(df, "g") == {"1": "Male"}
