import math
import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from gateledger.llm import topk
from gateledger.llm.queries import QUERIES


def best(rows, k, every):
    rows = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in rows:
        if q % every == 0:
            found = [(-sum(x * y for x, y in zip(a, b)), i) for i, b in rows if i != q and len(a) == len(b)]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def check(spark, rows, k=5, every=3):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = topk.top_k(df, k, every)
    assert sorted(map(tuple, got.collect())) == best([r[:2] for r in rows], k, every)


def test_ties_unusable_vectors_and_few_candidates(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25]) for _ in range(4)], "x") for i in range(60)]
    rows += [(60, None, "x"), (63, [1.0, None, 0.0, 0.0], "x"), (66, [float("nan")] * 4, "x"), (69, [float("inf")] * 4, "x"), (None, [1.0] * 4, "x")]
    rows += [(72, [0.5, 0.5], "x"), (73, [0.5, 0.25], "x"), (75, [], "x"), (-3, [0.25] * 4, "x")]
    check(spark, rows)
    check(spark, rows, k=1000)
    check(spark, [])


def test_large_components_stay_exact(spark):
    rng = random.Random(7)
    check(spark, [(i, [float(rng.randrange(-(10**7), 10**7)) for _ in range(3)], None) for i in range(40)])


def test_lowest_score_of_large_components(spark):
    check(spark, [(0, [2.4e7, 0.046875], None), (1, [-2.4e7, -0.046875], None)])  # the norm is rounded down by 9


def test_blocks_meet(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 7)
    monkeypatch.setattr(topk, "CANDIDATES", 11)
    rng = random.Random(8)
    check(spark, [(i, [rng.uniform(-1, 1) for _ in range(8)], None) for i in range(150)])


def test_candidate_blocks_of_a_task_are_counted_together(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 16)
    monkeypatch.setattr(topk, "CANDIDATES", 10)
    rng = random.Random(9)
    df = spark.createDataFrame([(i, [rng.randrange(8) for _ in range(4)]) for i in range(600)], "id long, v array<long>").coalesce(1)
    asked = topk.blocks(df.filter("id < 16"), 16, 16).withColumn("lows", F.transform("ids", lambda _: F.lit("-1000")))
    spread = topk.blocks(df, 10, 600).select(F.lit(0).alias("to"), F.col("dims").alias("long"), F.col("ids").alias("cids"), F.col("vs").alias("cvs"))
    counted = topk.counted(asked, spread.coalesce(1), 2000, 8)
    rows = topk.histogram(asked, spread, 2000, 8).collect()
    assert spread.count() > 30 and sum(r.n for r in rows) == 16 * 599
    assert counted.count() == len(rows)  # one task, so nothing is left to add up


def test_rows_of_one_id_spread_over_blocks(spark):
    df = spark.createDataFrame([(7, [float(i % 5)]) for i in range(3000)], "id long, v array<double>")
    sizes = [len(r.ids) for r in topk.blocks(df, 100, 3000).collect()]
    assert sum(sizes) == 3000 and max(sizes) < 250


def test_blocks_that_meet_are_not_joined_into_rows(spark):
    rng = random.Random(10)
    df = spark.createDataFrame([(i, [rng.randrange(8) for _ in range(4)]) for i in range(2000)], "id long, v array<long>")
    asked = topk.blocks(df.filter("id < 64"), 64, 64).withColumn("lows", F.transform("ids", lambda _: F.lit("-1000")))
    spread = topk.blocks(df, 100, 2000).select(F.lit(0).alias("to"), F.col("dims").alias("long"), F.col("ids").alias("cids"), F.col("vs").alias("cvs"))
    sent = topk.paired(asked, spread)
    n = sum(sent.agg(*[F.sum(F.size(c)) for c in sent.columns if c in ("vs", "cvs")]).head())
    assert n == (64 + 2000) * 4  # and not the queries again with each of the 20 blocks
    assert "Join" not in sent._jdf.queryExecution().executedPlan().toString()


def test_a_task_scores_some_pairs_at_a_time():
    rng = np.random.default_rng(11)
    asked = topk.Asked((0, 0, 0), np.arange(2048), rng.integers(-40, 40, (2048, 64), dtype=np.int8), [-200_000] * 2048)
    c = rng.integers(-40, 40, (4096, 64), dtype=np.int8)
    tracemalloc.start()
    n = sum(len(x[0]) for x in topk.inside(asked, np.arange(4096), c, 400_000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 2048 * 4095 and peak < 16e6  # 8 bytes for each pair would be 67 MB


def test_shares_and_slabs_of_blocks(spark, monkeypatch):
    for name, n in (("QUERIES", 7), ("CANDIDATES", 11), ("SHARE", 2), ("SLAB", 3)):
        monkeypatch.setattr(topk, name, n)
    rng = random.Random(12)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25]) for _ in range(rng.choice([3, 3, 100]))], None) for i in range(200)]
    check(spark, rows, k=7)
    check(spark, [(i, [0.5, 1.0], None) for i in range(200)], k=30)  # all tie


def test_components_of_any_width(spark):
    rng = random.Random(13)
    for far in (2, 512, 4.7e7):  # 128, 32,768 and more than 2^31 once times 64
        check(spark, [(i, [float(np.float32(far * rng.choice([-1, 1, rng.uniform(-1, 1)])))], None) for i in range(30)])


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(map(tuple, QUERIES["op10_exact_top_k"](spark, sf_dir).collect())) == best(rows, 20, 20)
