"""Window operators (WN-01 .. WN-17) and global ordered positions.

Per-series windows partition by the series key and order by date.  On the
daily tables (key, date) is unique, so a window partition holds at most one
row per calendar day: a "hot" location cannot blow up one task.  All
features of one series share one Window spec, so Catalyst sorts once.

Global order (row index, cumulative sums) never uses an unpartitioned
window.  ``prefix_sums`` turns the order into bucket numbers (bounds from a KLL
sketch, so the bucket is a plain expression), takes running sums inside each
bucket after one shuffle, and adds offsets from a table with one row per bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airwise.functions.dates import as_col


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def series(key: str | Sequence[str] | None = "location_id", order: str | Sequence[str] = "date"):
    """The shared per-series window (WN-08: key None = one series)."""
    keys = [key] if isinstance(key, str) else list(key or [])
    orders = [order] if isinstance(order, str) else list(order)
    w = Window.partitionBy(*keys) if keys else Window.partitionBy()
    return w.orderBy(*orders)


def lag(c, w, n: int = 1) -> Column:
    """WN-01/02: value n rows back, null at the start."""
    return F.lag(as_col(c), n).over(w)


def lag0(c, w, n: int = 1) -> Column:
    """WN-03: lag with 0 for a missing or null previous value."""
    return F.coalesce(F.lag(as_col(c), n).over(w), F.lit(0))


def delta(c, w, zero: bool = False) -> Column:
    """WN-04: today minus yesterday; zero=True turns the null start into 0."""
    d = as_col(c) - F.lag(as_col(c), 1).over(w)
    return F.coalesce(d, F.lit(0.0)) if zero else d


def rolling_full(c, w, n: int, how: str = "avg") -> Column:
    """WN-05/06: n-row window including today; null unless all n values exist."""
    frame = w.rowsBetween(-(n - 1), 0)
    agg = {"avg": F.avg, "max": F.max, "min": F.min, "sum": F.sum}[how](as_col(c)).over(frame)
    return F.when(F.count(as_col(c)).over(frame) == n, agg)


def rolling_prev(c, w, n: int) -> Column:
    """WN-07/08: mean of the n preceding rows (partial allowed), 0 when none."""
    return F.coalesce(F.avg(as_col(c)).over(w.rowsBetween(-n, -1)), F.lit(0.0))


def lead(c, w, n: int = 1) -> Column:
    """WN-09: value n rows ahead ("tomorrow")."""
    return F.lead(as_col(c), n).over(w)


def ffill_bfill(c, w) -> Column:
    """WN-11: forward fill, then back fill, along the series order.  Only the rows before a series'
    first value are left to the back fill, and all of them get that value: it is one aggregate
    over the whole series, computed once, so both frames are linear."""
    return F.coalesce(F.last(as_col(c), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
                      F.first(as_col(c), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """WN-12 / SNK-10: first row per key under a total order (dedupe)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def first_n_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """WN-16: first n rows per key by order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def next_day_label(df: DataFrame, key: str, label: str, out: str) -> DataFrame:
    """WN-10: next row's label per series; the last row (no next) is dropped."""
    w = series(key)
    return df.withColumn(out, F.lead(label, 1).over(w)).where(F.col(out).isNotNull())


# Fallback risk levels cycled over the days of a forecast (score, level, label).
FALLBACK_LEVELS = [(1.5, "low", "Low"), (2.0, "low", "Low"), (2.5, "moderate", "Moderate"),
                   (3.0, "moderate", "Moderate"), (3.5, "moderate", "Moderate"), (4.0, "high", "High"),
                   (4.5, "high", "High")]


def fallback_levels(day_index) -> Column:
    """WN-17: the static risk struct of day ``i`` of a forecast: FALLBACK_LEVELS[i mod 7]."""
    arr = F.array(*[F.struct(F.lit(s).alias("score"), F.lit(lv).alias("level"), F.lit(lb).alias("label"))
                    for s, lv, lb in FALLBACK_LEVELS])
    return F.element_at(arr, (F.pmod(as_col(day_index), F.lit(len(FALLBACK_LEVELS))) + 1).cast("int"))


def cycle_pick(values: Sequence, index) -> Column:
    """WN-17: values[index mod len] as a column."""
    arr = F.array(*[F.lit(v) for v in values])
    return F.element_at(arr, (F.pmod(as_col(index), F.lit(len(values))) + 1).cast("int"))


# --------------------------------------------------------------------------
# Global order without a single-partition window
# --------------------------------------------------------------------------

#: Buckets per shuffle partition: hashing this many to a partition evens out their sizes.
BUCKETS = 8


def _number(c: Column, kind: T.DataType) -> tuple[list[tuple[Column, str]], bool]:
    """Numbers that grow with ``c`` (each with its sketch type), most significant first, and whether equal numbers mean equal values."""
    if isinstance(kind, T.StringType):
        raw = F.encode(c, "UTF-8")
        part = lambda a: F.conv(F.rpad(F.hex(F.substring(raw, a, 7)), 14, "0"), 16, 10).cast("long")
        return [(part(1), "bigint"), (part(8), "bigint")], False
    if isinstance(kind, T.DateType):
        return [(F.unix_date(c).cast("long"), "bigint")], True
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return [(F.unix_micros(c.cast("timestamp")), "bigint")], True
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return [(c.cast("double"), "double")], True
    if isinstance(kind, T.DecimalType):
        return [(c.cast("double"), "double")], False
    return [(c.cast("long"), "bigint")], True


def _levels(df: DataFrame, order: Sequence[Column]) -> list[tuple[Column, str]]:
    """At most two numbers a row whose order is that of ``order``."""
    kinds = df.select(*[c.alias(f"o{i}") for i, c in enumerate(order)]).schema
    out: list[tuple[Column, str]] = []
    for c, f in zip(order, kinds):
        numbers, exact = _number(c, f.dataType)
        out += numbers
        if not exact or len(out) >= 2:
            break
    return out[:2]


def sketch_points(c: Column, kind: str, k: int, ranks: Sequence[float]) -> Column:
    """Aggregate: approximate values of ``c`` at normalised ``ranks`` from one mergeable KLL sketch (null without a value)."""
    agg, get = (F.kll_sketch_agg_double, F.kll_sketch_get_quantile_double) if kind == "double" else \
        (F.kll_sketch_agg_bigint, F.kll_sketch_get_quantile_bigint)
    sketch = agg(c, F.lit(k))
    return F.when(F.count(c) > 0, get(sketch, F.array(*[F.lit(float(r)) for r in ranks])))


def with_bucket(df: DataFrame, order: Sequence[Column], n: int, name: str = "_b") -> DataFrame:
    """``df`` with a number from 0 to n - 1 that never falls along ``order`` and holds about a share 1 / n of the rows.

    Bounds are quantiles of a KLL sketch of the first order number, one scalar subquery.  A value that
    spans several bounds (a third of all rows may share it) is spread over their buckets by the
    next number of the order, on quantiles of its own, which only such rows look up.  The place among the bounds is a binary
    search in one ``aggregate``: as a chain of projections it names each step's place several times, and the optimizer, tracing a join
    key down to its scan, writes the chain out as one expression that triples with every step."""
    levels = _levels(df, order)
    k = min(65535, max(1024, 16 * n))
    ranks = [i / n for i in range(1, n)]
    points = df.agg(F.struct(*[sketch_points(c, kind, k, ranks).alias(f"b{i}") for i, (c, kind) in enumerate(levels)]).alias("b")).scalar()
    steps = F.array(*[F.lit(1 << bit) for bit in range((n - 1).bit_length() - 1, -1, -1)])

    def count(bounds: Column, ahead) -> Column:
        """How many of the rising bounds are ahead (a place past the end is null, so none)."""
        return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(ahead(F.get(bounds, at + step - 1)), step).otherwise(0))

    x, y = F.col("_x0"), F.col("_x1")
    out = df.select("*", points.alias("_p"), *[c.alias(f"_x{i}") for i, (c, _) in enumerate(levels)])
    out = out.withColumn("_low", count(F.col("_p.b0"), lambda b: b < x))
    bucket = F.col("_low")
    if len(levels) > 1:
        wide = count(F.col("_p.b0"), lambda b: b <= x) - F.col("_low") + 1
        shift = F.floor(wide * count(F.col("_p.b1"), lambda b: b < y) / n).cast("int")
        bucket = bucket + F.when(F.get(F.col("_p.b0"), F.col("_low")) == x, shift).otherwise(0)
    # never null; said so, else a join on it checks every row for null and writes the whole search out once more below the joins and windows
    return out.select(*df.columns, F.coalesce(bucket, F.lit(0)).alias(name))


def prefix_sums(df: DataFrame, order: Sequence[Column], values: dict[str, Column],
                num_partitions: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Running sums of ``values`` along a total, ascending ``order`` (within each group of ``keys``), nulls first.

    Adds ``<name>_cum`` (inclusive running sum) and ``<name>_total`` columns.  ``with_bucket`` turns the
    order into a bucket number, a plain expression, so the rows are shuffled once (by bucket and
    keys); each bucket takes its own running sums, and what earlier buckets hold comes from a table of
    one row per (bucket, group): broadcast without groups (bounded by the bucket count), otherwise
    joined as AQE sees fit.  Nothing is checkpointed and nothing runs before the first action.

    The bounds come from one scalar subquery that both branches of the plan share (Spark reuses equal subqueries).  Were
    they ever different, the running row count of a bucket would pass its total: that raises an error.
    """
    spark = df.sparkSession
    n = BUCKETS * (num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions")))
    names, keys = [*values, "_rows"], list(keys)
    base = with_bucket(df.select("*", *[v.alias(f"_v_{k}") for k, v in values.items()], F.lit(1).cast("long").alias("_v__rows")), order, n)
    inside = Window.partitionBy("_b", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = base.select("*", *[F.sum(f"_v_{k}").over(inside).alias(f"_l_{k}") for k in names])
    totals = base.groupBy("_b", *keys).agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in names])
    w = Window.partitionBy(*keys).orderBy("_b")
    offsets = totals.select(
        F.col("_b").alias("_ob"), *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_t__rows"),
        *[F.coalesce(F.sum(f"_t_{k}").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_o_{k}") for k in values],
        *[F.sum(f"_t_{k}").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(f"_g_{k}") for k in values])
    on = F.col("_b") == F.col("_ob")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    # one row a bucket without keys, a proven bound; with keys AQE chooses by size
    out = local.join(F.broadcast(offsets) if not keys else offsets, on)
    sure = lambda c: F.when(F.col("_l__rows") <= F.col("_t__rows"), c).otherwise(F.raise_error(F.lit("bucket bounds differ between branches")))
    return out.select(*df.columns, *[sure(F.col(f"_o_{k}") + F.col(f"_l_{k}")).alias(f"{k}_cum") for k in values],
                      *[F.col(f"_g_{k}").alias(f"{k}_total") for k in values])


def row_index(df: DataFrame, order: Sequence[Column], name: str = "row_idx") -> DataFrame:
    """Exact 0-based position under a total order, plus the row count ``n_rows``."""
    out = prefix_sums(df, order, {"_one": F.lit(1).cast("long")})
    return (out.withColumn(name, F.col("_one_cum") - 1)
            .withColumnRenamed("_one_total", "n_rows").drop("_one_cum"))


def time_split(df: DataFrame, frac: float, order: Sequence[Column]) -> DataFrame:
    """WN-13: first floor(n*frac) rows (clamped to [1, n-1]) are 'train', rest 'test'."""
    idx = row_index(df, order)
    cut = F.greatest(F.lit(1), F.least(F.col("n_rows") - 1, F.floor(F.col("n_rows") * frac)))
    return idx.withColumn("split", F.when(F.col("row_idx") < cut, "train").otherwise("test"))


def time_split_test_size(df: DataFrame, ratio: float, order: Sequence[Column]) -> DataFrame:
    """WN-13 variant: test = the last max(1, int(n*ratio)) rows."""
    idx = row_index(df, order)
    n_test = F.greatest(F.lit(1), F.floor(F.col("n_rows") * ratio))
    return idx.withColumn("split", F.when(F.col("row_idx") < F.col("n_rows") - n_test, "train").otherwise("test"))


def n_folds_rule(n, rule: str = "main"):
    """WN-14 fold-count rules as column arithmetic."""
    n = as_col(n)
    if rule == "main":      # min(4, n // 20), at least 2
        return F.greatest(F.lit(2), F.least(F.lit(4), F.floor(n / 20)))
    if rule == "personal":  # min(5, n // 50), at least 2
        return F.greatest(F.lit(2), F.least(F.lit(5), F.floor(n / 50)))
    return F.lit(3)


def expanding_folds(df: DataFrame, k, order: Sequence[Column]) -> DataFrame:
    """WN-14: expanding-window CV.  test size = n // (k + 1); fold i (1..k) tests
    rows [n - (k - i + 1) * t, n - (k - i) * t) and trains on all earlier rows.
    Adds ``test_fold`` (fold whose test block holds the row, null if none).  ``k`` is a
    number, or a rule name of ``n_folds_rule`` evaluated on the row count in the plan."""
    idx = row_index(df, order)
    if isinstance(k, int):
        kk = F.lit(k)
    elif isinstance(k, str):
        kk = n_folds_rule(F.col("n_rows"), k)
    else:
        kk = as_col(k)
    t = F.floor(F.col("n_rows") / (kk + 1))
    start = F.col("n_rows") - kk * t
    fold = F.when((t > 0) & (F.col("row_idx") >= start), F.floor((F.col("row_idx") - start) / t) + 1)
    return idx.withColumn("n_folds", kk.cast("long")).withColumn("test_size", t.cast("long")) \
              .withColumn("test_fold", fold.cast("long"))
