import random

import pytest
from pyspark.sql import functions as F

from gateledger.operators import joins, windows
from gateledger.operators.scan import Running, first_rows, pick_per_key, running, running_by_key


def rows(n=400, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        key = 0 if r.random() < 0.4 else r.randrange(1, 30)  # one key holds over a third
        out.append((key, r.randrange(0, 900), i, r.choice([None, -2, -1, 0, 1, 5]), r.choice([None, "a", "bb"])))
    return out


@pytest.mark.parametrize("before", [False, True])
def test_bucketed_equals_plain(spark, before):
    df = spark.createDataFrame(rows(), "k int, at int, id int, v bigint, s string")
    values = {f"{kind}_v": Running(kind, F.col("v"), before) for kind in ("sum", "count", "min", "max", "last")}
    values["text_s"] = Running("text", F.col("s"), before)
    plain = running(df, ["k"], ["at", "id"], values)
    bucketed = running(df, ["k"], ["at", "id"], values, F.floor(F.col("at") / 50))
    split = running_by_key(df, ["k"], ["at", "id"], values, F.floor(F.col("at") / 7), hot_rows=50)
    want = sorted(map(tuple, plain.collect()), key=repr)
    assert sorted(map(tuple, bucketed.collect()), key=repr) == want
    assert sorted(map(tuple, split.select(*plain.columns).collect()), key=repr) == want


@pytest.mark.parametrize("hot_rows", [0, 30])
def test_null_keys_and_orders_come_out_the_same_at_every_size(spark, hot_rows):
    some = [(None if k == 3 or k == 0 and i % 2 else k, None if i % 11 == 0 else at, i, v, s) for k, at, i, v, s in rows()]
    df = spark.createDataFrame(some, "k int, at int, id int, v bigint, s string")
    values = {f"{kind}_v": Running(kind, F.col("v")) for kind in ("sum", "count", "min", "max", "last")}
    values["text_s"] = Running("text", F.col("s"))
    bucket = F.floor(F.col("at") / 7)
    few, many = (running_by_key(df, ["k"], ["at", "id"], values, bucket, hot_rows=n) for n in (10**9, hot_rows))
    want = sorted(map(tuple, few.collect()), key=repr)
    assert len(want) == len(some)
    assert sorted(map(tuple, many.select(*few.columns).collect()), key=repr) == want


def test_pick_per_key_limits_before_the_shuffle(spark):
    df = spark.createDataFrame(rows(), "k int, at int, id int, v bigint, s string")
    picked = pick_per_key(df, ["k"], [F.desc("at"), F.desc("id")])
    best = {}
    for k, at, i, *_ in rows():
        best[k] = max(best.get(k, (-1, -1)), (at, i))
    assert {(r.k, r.at, r.id) for r in picked.collect()} == {(k, *v) for k, v in best.items()}
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 1, Partial" in plan  # below the exchange


@pytest.mark.parametrize("n", [1, 3, 40])
def test_first_rows_with_and_without_salts(spark, n):
    df = spark.createDataFrame(rows(), "k int, at int, id int, v bigint, s string").select("k", "at", "id")
    want = []
    for key in {r[0] for r in rows()}:
        want += sorted((k, at, i) for k, at, i, *_ in rows() if k == key)[:n]
    for threshold in ("1000", "2"):
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", threshold)
        try:
            assert sorted(map(tuple, first_rows(df, ["k"], ["at", "id"], n).collect())) == sorted(want)
        finally:
            spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")


def test_rolling_counts_against_brute_force(spark):
    r = random.Random(3)
    base = 1_700_000_000
    gates = [(str(i), r.randrange(3), base + r.choice([0, 3600, 86400]) * r.randrange(4)) for i in range(120)]
    df = spark.createDataFrame(gates, "id string, installation_id bigint, at bigint").select(
        "id", "installation_id", F.timestamp_seconds("at").alias("created_at")
    )
    for hot in (10**9, 5):
        got = {x.id: (x.installation_before, x.global_before) for x in windows.rolling_gate_counts(df, hot_rows=hot).collect()}
        for i, inst, at in gates:
            earlier = [g for g in gates if (g[2], g[0]) < (at, i) and g[2] >= at - 86400]
            assert got[i] == (sum(g[1] == inst for g in earlier), len(earlier))


def test_asof_takes_a_gate_of_the_same_instant(spark):
    comments = spark.createDataFrame([(1, 1, 10, 7), (1, 1, 4, 8), (2, 1, 10, 9)], "repo_id bigint, pr_number int, t int, comment_id bigint")
    gates = spark.createDataFrame([(1, 1, 5, "a"), (1, 1, 10, "b"), (1, 1, 11, "c")], "repo_id bigint, pr_number int, t int, id string")
    got = joins.comment_gate_asof(
        comments.withColumn("ts", F.timestamp_seconds("t")), gates.withColumn("created_at", F.timestamp_seconds("t")), hot_rows=1
    )
    assert {(r.comment_id, r.gate_id) for r in got.collect()} == {("7", "b"), ("8", None), ("9", None)}


def test_gate_attempts_keeps_gates_without_any(spark):
    gates = spark.createDataFrame([("a",), ("b",)], "id string")
    attempts = spark.createDataFrame([("x", "a"), ("y", "a")], "id string, checkpoint_id string")
    got = joins.gate_attempts(gates, attempts).collect()
    assert {(r.id, r.attempt_id) for r in got} == {("a", "x"), ("a", "y"), ("b", None)}
