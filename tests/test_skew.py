"""Skew: one key holding a third of all rows must not land in one task."""

from pyspark.sql import functions as F

from airwise.operators import windows as W
from airwise.operators.quantiles import exact_quantiles


def _skewed(spark, n=30000):
    # a third of the rows share g = 0 and the same value v = 1.0
    return spark.range(n).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 997).alias("g"),
                                 F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.col("id") / 7.0).alias("v"))


def test_prefix_sums_balanced_under_a_hot_key(spark):
    df = _skewed(spark)
    out = W.row_index(df, [F.col("g"), F.col("id")])
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    # a third of the rows share g = 0, but the total order (g, id) still splits them
    assert max(sizes) <= 2.5 * (sum(sizes) / len(sizes))
    assert out.agg(F.max("row_idx")).first()[0] == 29999


def test_exact_median_with_a_hot_value(spark):
    df = _skewed(spark, 3001)
    got = exact_quantiles(df, "v", [0.5]).first()[0]
    vals = sorted([1.0 if i % 3 == 0 else i / 7.0 for i in range(3001)])
    assert got == vals[1500]


def test_rollup_is_partial_before_the_shuffle(spark):
    df = _skewed(spark)
    plan = df.groupBy("g").agg(F.avg("v")).select("*")._jdf.queryExecution().executedPlan().toString()
    assert "partial_avg" in plan


def _sorted_sums(rows):
    """(place, running sum) of rows sorted with nulls first and NaN last, as plain Python."""
    key = lambda x: (x is not None, x != x if isinstance(x, float) else False, 0 if x is None or x != x else x)
    out, at = {}, 0
    for i, (_, u) in enumerate(sorted(rows, key=lambda r: (key(r[0]), r[1]))):
        at += u
        out[u] = (i, at)
    return out


def test_prefix_sums_over_every_kind_of_order(spark):
    """Numbers, text, dates and timestamps, with nulls, NaN and a value that a third of the rows share."""
    base = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") * 37 % 1000).alias("k"))
    for c in (F.col("k"), F.when(F.col("id") % 90 == 4, float("nan")).otherwise(F.col("k") / 3), F.concat(F.lit("name-of-a-"), F.col("k").cast("string")),
              F.date_add(F.lit("2020-01-01").cast("date"), F.col("k").cast("int")), F.timestamp_seconds(F.col("k")), F.col("k").cast("decimal(20,3)")):
        df = base.select(c.alias("o"), "id")
        jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
        out = W.prefix_sums(df, [F.col("o"), F.col("id")], {"u": F.col("id"), "one": F.lit(1).cast("long")})
        assert spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs() == jobs  # nothing runs before the first action
        rows = out.collect()
        want = _sorted_sums([(r.o if not hasattr(r.o, "isoformat") else r.o.isoformat(), r.id) for r in rows])
        assert {r.id: (r.one_cum - 1, r.u_cum) for r in rows} == want and all(r.one_total == 900 for r in rows)


def test_one_full_shuffle_for_a_global_order(spark):
    out = W.row_index(_skewed(spark), [F.col("g"), F.col("id")])
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "ReusedSubquery" in plan  # both branches see one set of bounds
    assert plan.count("Exchange hashpartitioning(_b#") == 4  # the rows and the totals of the buckets, in the final plan and in the first one


def test_selection_matches_sorting(spark):
    """Brackets: more values than the sketch holds exactly, hot values, ties around a wanted rank, several columns and points at once."""
    df = _skewed(spark, 60000).select("v", (F.col("id") % 5).cast("double").alias("few"), F.when(F.col("id") % 4 > 0, F.exp(F.col("id") / 3000)).alias("steep"))
    rows = df.collect()
    qs = [0.0, 0.001, 0.2, 1 / 3, 0.5, 0.9, 1.0]
    for c in df.columns:
        got = exact_quantiles(df, c, qs).first()
        vals = sorted(r[c] for r in rows if r[c] is not None)
        for j, q in enumerate(qs):
            pos = (len(vals) - 1) * q
            lo = int(pos)
            want = vals[lo] + (vals[min(lo + 1, len(vals) - 1)] - vals[lo]) * (pos - lo)
            assert abs(got[j] - want) <= 1e-9 * max(1.0, abs(want))


def test_precision_at_k_ranks_ties_exactly(spark):
    from airwise.operators.sorts import precision_at_k
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 0.5).when(F.col("id") % 11 == 0, None).otherwise(F.col("id") * 7 % 100 / 100).alias("p"),
                                  (F.col("id") % 4 == 0).cast("int").alias("y"))
    rows = sorted(df.collect(), key=lambda r: (r.p is None, -(r.p or 0), r.id))
    for frac in (0.0, 0.2, 0.5, 0.97, 1.0):
        k = max(1, -int(-len(rows) * frac // 1))
        got = precision_at_k(df, "p", "y", frac, tie="id").first()
        assert (got.k, got.n) == (k, 5000) and abs(got.precision_at_k - sum(r.y for r in rows[:k]) / k) < 1e-12
    assert tuple(precision_at_k(df.limit(0), "p", "y", 0.2, tie="id").first()) == (None, 0, None)


def test_bucket_search_does_not_grow_the_plan(spark):
    """More buckets are more steps of one search, not more projections, and the places are those of a plain binary search."""
    from bisect import bisect_left

    df = spark.range(900).select((F.col("id") * 37 % 100).alias("o"), "id")  # few enough for an exact sketch
    shape = lambda n: W.with_bucket(df, [F.col("o"), F.col("id")], n, "b")._jdf.queryExecution().analyzed().toString().count("Project [")
    assert shape(16) == shape(1024)
    rows = W.with_bucket(df, [F.col("o")], 64, "b").collect()
    bounds = df.agg(W.sketch_points(F.col("o"), "bigint", 1024, [i / 64 for i in range(1, 64)])).first()[0]
    assert {(r.o, r.b) for r in rows} == {(r.o, bisect_left(bounds, r.o)) for r in rows}


def test_index_plans_at_many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        df = spark.range(3000).select(F.md5(F.col("id").cast("string")).alias("h"), (F.col("id") % 3).alias("y"), "id")
        out = W.prefix_sums(df, [F.col("h"), F.col("id")], {"one": F.lit(1).cast("long")}, keys=["y"])
        rows = out.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {i: n for y in range(3) for n, (_, i) in enumerate(sorted((r.h, r.id) for r in rows if r.y == y), 1)}
    assert {r.id: r.one_cum for r in rows} == want and all(r.one_total == 1000 for r in rows)


def test_index_names_its_sketch_once_a_branch(spark):
    """The bucket is never null, so no null check repeats the search, and with it the sketch of the whole table, below the joins."""
    df = spark.range(3000).select((F.col("id") * 7 % 50).alias("g"), "id")
    for keys in ([], ["g"]):
        out = W.prefix_sums(df, [F.col("g"), F.col("id")], {"one": F.lit(1).cast("long")}, keys=keys)
        assert out._jdf.queryExecution().executedPlan().toString().count("kll_sketch_agg") <= 8  # two numbers, partial and final, two branches
    nulls = spark.createDataFrame([(None, 1), (2.0, 2), (None, 3), (float("nan"), 4)], "o double, id long")
    assert [(r.id, r.row_idx) for r in W.row_index(nulls, [F.col("o"), F.col("id")]).orderBy("row_idx").collect()] == [(1, 0), (3, 1), (2, 2), (4, 3)]
