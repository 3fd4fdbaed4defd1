"""Sinks and upserts (SNK-01 .. SNK-11).

Plain parquet has no MERGE, so every upsert is a join/union plan that
produces the new table state; ``write_*`` persists it.  ``upsert_partitions`` does
so on a stored date-partitioned table and reads and rewrites (by dynamic partition overwrite) only the
partitions touched by the new rows.  Scratch output goes
under the cluster's shared ``spark.checkpoint.dir``, never a local folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airwise.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/airwise-out/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in a fresh folder and read again: for a table that several passes read a few columns of."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """SNK-01: CSV with a header."""
    df.write.mode(mode).option("header", True).csv(path)
    return path


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """SNK-02: JSON records (one object per line; nested structs/arrays kept)."""
    df.write.mode(mode).json(path)
    return path


def upsert_replace(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SNK-03: a new row fully replaces the old row of its key."""
    u = new.select(*old.columns).withColumn("_new", F.lit(1)).unionByName(old.withColumn("_new", F.lit(0)))
    w = Window.partitionBy(*keys).orderBy(F.col("_new").desc())
    return u.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_new")


def upsert_merge(old: DataFrame, new: DataFrame, keys: Sequence[str], set_cols: Sequence[str] | None = None,
                 null_keeps_old: bool = False) -> tuple[DataFrame, DataFrame]:
    """SNK-04: bulk ``$set`` upsert: every column that ``new`` brings is set, nulls included; the
    rest is kept.  With ``null_keeps_old`` a null counts as not supplied.  Returns (table, one-row
    count of rows inserted + changed); an update that changes nothing is not counted."""
    keys = list(keys)
    cols = [c for c in (set_cols or [c for c in new.columns if c not in keys])]
    o = old.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in old.columns if c not in keys], F.lit(True).alias("_in_old"))
    n = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in cols], F.lit(True).alias("_in_new"))
    j = o.join(n, keys, "full")
    given = lambda c: F.col(f"_n_{c}").isNotNull() if null_keeps_old else F.lit(True)
    out_cols = []
    for c in old.columns:
        if c in keys:
            continue
        if c in cols:
            out_cols.append(F.when(F.col("_in_new") & given(c), F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}")).alias(c))
        else:
            out_cols.append(F.col(f"_o_{c}").alias(c))
    for c in cols:
        if c not in old.columns:
            out_cols.append(F.col(f"_n_{c}").alias(c))
    changed = F.lit(False)
    for c in cols:
        if c in old.columns:
            changed = changed | (given(c) & ~F.col(f"_n_{c}").eqNullSafe(F.col(f"_o_{c}")))
    inserted = F.col("_in_new") & F.col("_in_old").isNull()
    touched = inserted | (F.col("_in_new") & F.col("_in_old") & changed)
    table = j.select(*keys, *out_cols)
    count = j.agg(F.count_if(F.coalesce(touched, F.lit(False))).alias("n_upserted"))
    return table, count


def upsert_columns(old: DataFrame, new: DataFrame, keys: Sequence[str], struct_col: str,
                   fields: Sequence[str], now: Column) -> DataFrame:
    """SNK-05: partial upsert of some fields of one nested struct, stamping ingestedAt.
    Rows of ``new`` without an old row are inserted with only those fields."""
    keys = list(keys)
    n = new.select(*keys, *[F.col(f).alias(f"_n_{f}") for f in fields], F.lit(True).alias("_in_new"))
    j = old.withColumn("_in_old", F.lit(True)).join(n, keys, "full")
    st = F.col(struct_col)
    base = F.when(st.isNull(), F.struct(*[F.lit(None).cast(t.dataType).alias(t.name)
                                          for t in old.schema[struct_col].dataType.fields])).otherwise(st)
    for f in fields:
        base = base.withField(f, F.when(F.col("_in_new"), F.col(f"_n_{f}")).otherwise(st[f]))
    others = [c for c in old.columns if c not in keys + [struct_col, "ingestedAt"]]
    return j.select(*keys, *others, F.when(F.col("_in_new") | st.isNotNull(), base).alias(struct_col),
                    F.when(F.col("_in_new"), now).otherwise(F.col("ingestedAt")).alias("ingestedAt"))


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """SNK-06: delete every old row of the keys present in ``new``, insert ``new``."""
    keep = old.join(new.select(key).distinct(), key, "left_anti")
    return keep.unionByName(new.select(*old.columns))


def nest_checkins(users: DataFrame, checkins: DataFrame, key: str = "user_id") -> DataFrame:
    """Nested layout: each user with its check-ins as an array ordered by date
    (one check-in per user-day, so a user's array is bounded by the calendar)."""
    arr = checkins.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(
        F.date_format("date", "yyyy-MM-dd").alias("date"), "wheeze", "cough", "chestTightness",
        "exerciseMinutes"))).alias("checkIns"))
    return users.join(arr, key, "left")


def append_checkin(users: DataFrame, new: DataFrame, key: str = "user_id", arr: str = "checkIns", order: Sequence[str] = ()) -> DataFrame:
    """SNK-07: merge new check-ins into each user's array by day; unknown users are a no-op.

    Of several new records of a day the last under ``order`` counts (ties, and no order: the largest
    record), and it takes the place of a record of that day that is already stored, so a repeated
    run changes nothing.  Days stored twice are mended on the way: the later element stays.  The array is ordered by
    date and bounded by the calendar: one record a day.  ``order`` columns that the stored record has not are left out of it."""
    fields = [f.name for f in users.schema[arr].dataType.elementType.fields]
    record = F.struct(*[F.col(c) for c in fields])
    last = new.groupBy(key, "date").agg(F.max(F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], record.alias("_r"))).alias("_last"))
    add = last.groupBy(key).agg(F.collect_list(F.col("_last._r")).alias("_add"))
    j = users.join(add, key, "left")
    old = F.coalesce(F.col(arr), F.array().cast(j.schema[arr].dataType))
    dates = lambda a: F.transform(a, lambda x: x["date"])
    once = F.filter(old, lambda x, i: ~F.array_contains(dates(F.slice(old, i + 2, F.size(old))), x["date"]))
    kept = F.filter(once, lambda x: ~F.array_contains(dates(F.col("_add")), x["date"]))
    merged = F.array_sort(F.concat(kept, F.col("_add")), lambda a, b: F.when(a["date"] < b["date"], -1).when(a["date"] > b["date"], 1).otherwise(0))
    return j.withColumn(arr, F.when(F.col("_add").isNull(), F.col(arr)).otherwise(merged)).drop("_add")


def upsert_partitions(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str], how: str = "merge",
                      set_cols: Sequence[str] | None = None, part: str = "date") -> int:
    """SNK-03 / SNK-04 / SNK-06 on a stored table laid out by ``part`` (``write_daily``): only the partitions that ``new``
    touches are read and written again; all others keep their files.

    ``how``: "replace" (a new row replaces the row of its key), "merge" (``upsert_merge``), or "delete_insert" (all old
    rows of a key that ``new`` has go, in these partitions).  The touched days come to the driver: a
    set bounded by the calendar, which makes the scan's partition filter static.  The merged partitions are
    checkpointed before they are written, since they come from the files that they replace.  Returns the number of partitions written.
    A retry after a failure gives the same table."""
    from airwise.session import cut_lineage

    days = [r[0] for r in new.select(part).distinct().collect()]
    if not days:
        return 0
    table = spark.read.parquet(path)
    hit = F.col(part).isin([d for d in days if d is not None])
    old = table.where(hit | F.col(part).isNull() if None in days else hit)
    if how == "merge":
        out = upsert_merge(old, new, keys, set_cols)[0]
    elif how == "replace":
        out = upsert_replace(old, new, keys)
    elif how == "delete_insert":
        out = old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new.select(*old.columns))
    else:
        raise ValueError(f"unknown upsert: {how}")
    write_daily(cut_lineage(out.select(*table.columns)), path)
    return len(days)


def upsert_users(old: DataFrame, new: DataFrame, now: Column, key: str = "user_id",
                 profile_keys: Sequence[str] = ("name", "height", "weight", "gender", "smokerStatus", "petExposure", "bmi")
                 ) -> DataFrame:
    """SNK-08: only supplied fields change (profile merged field by field, all
    keys present); createdAt set once, updatedAt always on touched users."""
    top = [c for c in new.columns if c not in (key, "profile")]
    o = old.select(key, *[F.col(c).alias(f"_o_{c}") for c in old.columns if c != key], F.lit(True).alias("_in_old"))
    n = new.select(key, *[F.col(c).alias(f"_n_{c}") for c in new.columns if c != key], F.lit(True).alias("_in_new"))
    j = o.join(n, key, "full")
    cols = []
    for c in [c for c in old.columns if c not in (key, "profile", "createdAt", "updatedAt")]:
        cols.append((F.coalesce(F.col(f"_n_{c}"), F.col(f"_o_{c}")) if c in top else F.col(f"_o_{c}")).alias(c))
    new_fields = {f.name for f in new.schema["profile"].dataType.fields} if "profile" in new.columns else set()
    old_fields = {f.name for f in old.schema["profile"].dataType.fields}
    prof = F.struct(*[F.coalesce(*([F.col(f"_n_profile.{k}")] if k in new_fields else []),
                                 *([F.col(f"_o_profile.{k}")] if k in old_fields else []),
                                 F.lit(None).cast("string")).alias(k) for k in profile_keys])
    cols.append(prof.alias("profile"))
    cols.append(F.coalesce(F.col("_o_createdAt"), now).alias("createdAt"))
    cols.append(F.when(F.col("_in_new"), now).otherwise(F.col("_o_updatedAt")).alias("updatedAt"))
    return j.select(key, *cols)


def save_predictions(cache: DataFrame, preds: DataFrame, target: str, now: Column,
                     keys: Sequence[str] = ("user_id", "date")) -> DataFrame:
    """SNK-09: upsert predictions by (user_id, date) with the target column and updated_at."""
    new = preds.select(*keys, F.col(target), now.alias("updated_at"))
    table, _ = upsert_merge(cache, new, keys, [target, "updated_at"])
    return table


def dedupe_keys(df: DataFrame, keys: Sequence[str] = ("location_id", "date"), order: Sequence[Column] | None = None) -> DataFrame:
    """SNK-10: one row per key (the first under ``order``; default: keys + all columns)."""
    w = Window.partitionBy(*keys).orderBy(*(order or [F.col(c) for c in df.columns]))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def write_daily(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """SNK-10: daily table laid out by date partitions, sorted by location inside each file; dynamic
    overwrite replaces only the dates present in ``df``.  The rebalance keeps a date's rows together
    where they are few and lets AQE split a date that holds most rows over several tasks and files."""
    (df.hint("rebalance", "date").sortWithinPartitions("date", "location_id")
       .write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path))
    return path


def write_report(lines: DataFrame, path: str) -> str:
    """SNK-11: a text report: (line_no, value) rows, one file per range of line numbers.  Files are in
    order, and so are the lines in a file."""
    (lines.repartitionByRange("line_no").sortWithinPartitions("line_no")
        .select(F.concat_ws("\t", F.format_string("%012d", "line_no"), "value").alias("value")).write.mode("overwrite").text(path))
    return path


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """SNK-11 read back: (line_no, value)."""
    raw = spark.read.text(path)
    return raw.select(F.substring_index("value", "\t", 1).cast("long").alias("line_no"),
                      F.expr("substring(value, instr(value, '\t') + 1)").alias("value"))
