"""The driver's contract, and a stream of updates."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from keyloom.operators.buffers import WriteBuffer
from keyloom.queries import QUERIES, SQL
from keyloom.sources.cells import fill
from keyloom.streaming.buffers import StreamedTarget, updates_from


def test_entry(spark):
    row = entry.entry(spark).first()
    assert row.n > 0 and row.loss > 0


def test_oracle_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_says_the_same(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in set(re.findall(r"\b(lineitem|orders|customer|nation|part|events|documents|embeddings)\b", SQL[name])):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.sql(SQL[name]).df()
    got = QUERIES[name](spark, sf).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda x: [str(y) for y in x] if isinstance(x, (list, np.ndarray)) else str(x)
    key = lambda df: sorted(json.dumps([plain(x) for x in r]) for r in df[sorted(df.columns)].itertuples(index=False))
    assert key(got) == key(want)


def test_streamed_updates(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(1, 1.0), (2, float(k))], "k1 long, update double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    target = StreamedTarget(fill(spark, 0.0, 3), WriteBuffer(F.sum), str(tmp_path / "versions"))
    query = target.apply(updates_from(spark, str(tmp_path / "in"), "k1 long, update double"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    assert {r.k1: r.value for r in target.at(2).df.collect()} == {1: 3.0, 2: 3.0, 3: 0.0}


def test_pushdown_and_fusion(spark, sf):
    plan = QUERIES["q_gather_keys"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(p_size,7)" in plan
    plan = QUERIES["q_point_lookup"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "l_tax" not in plan and "l_shipdate" not in plan
    plan = QUERIES["q_map_chain"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project") <= 2 and "Python" not in plan
