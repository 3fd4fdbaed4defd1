"""Helpers shared by the operators: tables in the shared folder, word arrays, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airwise.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Fixed value: everything that is no ASCII letter or digit separates words; all above ASCII joins them.
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: lineage is cut, the
    rows (generated ids included) are fixed, and a lost executor loses nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of few rows for the Python passes over whole texts, so long texts don't pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def ascii_lower(c: Column) -> Column:
    """A-Z lowered, all other characters kept."""
    return F.translate(c, UPPER, UPPER.lower())


def text_of(c: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def word_array(text: Column) -> Column:
    """Words of a lower-cased text: runs of ASCII letters, digits and non-ASCII characters."""
    return F.array_remove(F.split(ascii_lower(text), WORD_BREAK, -1), "")


def text_keys(text: Column) -> list[Column]:
    """Two independent hashes of the text; with the id they name a row's content."""
    return [F.xxhash64(text).alias("th"), F.hash(text).alias("tm")]


def beside(docs: DataFrame, verdicts: DataFrame, how: str = "left") -> DataFrame:
    """Rows of ``docs`` packed in one column ``doc``, joined with ``verdicts`` (doc_id, th, tm and more) by id and content.
    A packed row can have columns of any name: none meets the names of the verdicts."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs["doc_id"].alias("_id"), F.xxhash64(text_of()).alias("_th"), F.hash(text_of()).alias("_tm"))
    found = verdicts.withColumnsRenamed({"doc_id": "_vid", "th": "_vth", "tm": "_vtm"})
    out = rows.join(found, F.col("_id").eqNullSafe(F.col("_vid")) & (F.col("_th") == F.col("_vth")) & (F.col("_tm") == F.col("_vtm")), how)
    return out.drop("_id", "_th", "_tm", "_vid", "_vth", "_vtm")


def unpacked(docs: DataFrame, text: Column | None = None, changed: Column | None = None) -> list[Column]:
    """The columns of ``docs`` from the packed ``doc``; ``text`` replaces the text where ``changed``, and n_chars is counted anew there."""
    cols = []
    for f in docs.schema:
        c = F.col("doc").getField(f.name)
        if text is not None and f.name == "text":
            c = F.when(changed, text).otherwise(c)
        elif text is not None and f.name == "n_chars":
            c = F.when(changed, F.length(text)).otherwise(c).cast(f.dataType)
        cols.append(c.alias(f.name))
    return cols


def components(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """Connected components of an undirected edge list: (node, root), root the smallest node.

    Alternating large-star and small-star rounds: a round keeps at most as many edges as the one
    before it, each edge list is a table in the shared folder, and nothing but two totals of it
    comes to the driver.  The smallest neighbour is a partial aggregate; the join with it is an
    equi-join that AQE splits when one node has most edges.
    """
    spark = edges.sparkSession
    cur = stored(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v")
                 .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")

    def sign(df: DataFrame):
        r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        return r["n"], r["s"]

    before = sign(cur)
    while before[0]:
        # large star: every larger neighbour of u is linked to the smallest of u and its neighbours
        both = cur.union(cur.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours are linked to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")) \
            .where("u != v").distinct()
        cur = stored(small, "edges")
        now = sign(cur)
        if now == before:
            break
        before = now
    roots = cur.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()) \
        if before[0] else spark.createDataFrame([], roots.schema)
