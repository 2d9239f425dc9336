"""Exact ranks without hot-group windows; splits and samples."""

import pytest
from pyspark.sql import Window, functions as F

from tuneval.operators import ranking, sampling


def skewed(spark, n=3000):
    # one group holds ~1/3 of the rows, the rest spread over many groups
    return spark.range(n).select(F.col("id").alias("prompt_id"),
                                 F.when(F.col("id") % 3 == 0, F.lit("hot"))
                                  .otherwise((F.col("id") % 97).cast("string")).alias("g")) \
                .repartition(7)


def test_rank_within_equals_row_number(spark):
    df = skewed(spark)
    got = ranking.rank_within(df, ["g"], ["prompt_id"], "r", count_col="n")
    exp = df.withColumn("r2", F.row_number().over(Window.partitionBy("g").orderBy("prompt_id")))
    j = got.join(exp, ["prompt_id", "g"])
    assert j.where(F.col("r") != F.col("r2")).count() == 0
    assert got.count() == 3000


def test_positions_independent_of_partitioning(spark):
    df = skewed(spark)
    a = ranking.positions(df.repartition(1), ["prompt_id"]).collect()
    b = ranking.positions(df.repartition(11), ["prompt_id"]).collect()
    assert sorted((r.prompt_id, r.pos) for r in a) == sorted((r.prompt_id, r.pos) for r in b)
    assert sorted(r.pos for r in a) == list(range(1, 3001))


def test_holdout_is_exact_and_disjoint(spark):
    df = skewed(spark)
    s = sampling.holdout_split(df, 100)
    assert s.where("split = 'eval'").count() == 100
    assert s.count() == 3000
    per = sampling.holdout_split(df, 5, by=("g",))
    counts = {r.g: r.n for r in per.where("split = 'eval'").groupBy("g").count()
              .withColumnRenamed("count", "n").collect()}
    assert counts["hot"] == 5 and all(v == 5 for v in counts.values())


def test_fraction_sample_and_prefix(spark):
    df = skewed(spark)
    s = sampling.fraction_sample(df, 0.1, by=("g",))
    sizes = {r.g: r["count"] for r in df.groupBy("g").count().collect()}
    got = {r.g: r["count"] for r in s.groupBy("g").count().collect()}
    assert got == {g: max(1, int(n * 0.1)) for g, n in sizes.items()}
    pre = ranking.first_fraction(df, ["g"], ["prompt_id"], 0.5)
    hot = sorted(r.prompt_id for r in pre.where("g = 'hot'").collect())
    assert hot == sorted(r.prompt_id for r in df.where("g = 'hot'").orderBy("prompt_id")
                         .limit(sizes["hot"] // 2).collect())


def test_stride_split_and_contamination(spark):
    df = spark.createDataFrame([(i, f"q{i % 40}", "") for i in range(100)],
                               "prompt_id long, instruction string, input string")
    pos = sampling.seeded_shuffle(df)
    st = sampling.stride_split(pos)
    assert st.where("split = 'eval'").count() == 50
    ev = st.where("split = 'eval'")
    flags = sampling.contamination(ev, df)
    assert flags.count() == flags.where("in_train").count() == 50      # the reference's 100 % overlap
    train = st.where("split = 'train'")
    held = {r.instruction for r in train.collect()}
    for r in sampling.contamination(ev, train).collect():
        assert r.in_train == (r.instruction in held)


def test_top_k_plan_has_partial_group_limit(spark):
    df = skewed(spark)
    t = ranking.top_k(df, ["g"], ["prompt_id"], 3)
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert t.where("g = 'hot'").count() == 3


def test_lead_within_matches_window_lead(spark):
    # one hot group spanning many buckets, gaps in the order key, nulls in values
    rows = [(0 if i % 3 else i % 17, i * 3 + (i % 2), None if i % 11 == 0 else f"v{i}")
            for i in range(4000)]
    df = spark.createDataFrame(rows, "g long, t long, v string")
    got = ranking.lead_within(df, ["g"], "t", ["v"], bucket=64)
    exp = df.withColumn("v_exp", F.lead("v").over(Window.partitionBy("g").orderBy("t")))
    j = got.join(exp, ["g", "t"])
    assert j.count() == 4000
    assert j.where(~F.col("v_next").eqNullSafe(F.col("v_exp"))).count() == 0


@pytest.mark.parametrize("bits", [32, 64])
def test_with_smallest_matches_a_sort(spark, bits):
    import random
    rng = random.Random(bits)
    low = 0 if bits == 32 else -(1 << 63)
    rows = [(rng.choice(["a", "b", None]), rng.choice([low, 5, rng.randrange(1 << 31), (1 << (bits - 1)) - 1]), i)
            for i in range(300)]
    df = spark.createDataFrame(rows, "g string, key long, id long").repartition(5)
    for k in (0, 1, 40, 1000):
        got = {r.id for r in ranking.with_smallest(df, "key", lambda n: F.lit(k), ["g"], ["id"], bits).where("in_k").collect()}
        want = {i for g in ("a", "b", None) for _, i in sorted((x, i) for h, x, i in rows if h == g)[:k]}
        assert got == want, k
    half = ranking.with_smallest(df, "key", lambda n: F.floor(n / 2), (), ["id"], bits)
    assert half.columns == [*df.columns, "in_k"] and half.where("in_k").count() == 150 and half.count() == 300
