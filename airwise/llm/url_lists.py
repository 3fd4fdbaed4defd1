"""Operator 5, URL filters: captures judged by the list entries that were active at fetch time.

A list is a log of dated entries: from a day on, a key (a host, any of its parent domains, or a host
with the first path segment) is blocked, allowed or removed.  The log becomes validity intervals: the
entries of a key in order, each valid until the next one's day; of several entries of one day block
wins over allow and allow over remove.  Removal ends an interval and starts none.

As-of join: the intervals of a key are kept in one row, sorted, so the join of captures with keys is an
equi-join that never multiplies a capture by a key's history; the interval of the fetch day is then
picked inside the row.  A key's history is bounded by the calendar (one interval per day at most).
A capture asks for a bounded number of keys (a DNS name has 253 characters at most; a longer host is
no name and asks for none).  The verdict is that of the most specific key that is active: path
before host, host before parent.  A host that a third of all captures share is one row on the list's
side and is split by AQE on the captures' side; captures are grouped by row, never by host.

Rows: a null or malformed url, or a null fetch day, meets no entry and is kept (verdict none).
Repeated rows get a row each; null keys, days or actions in the list are ignored; empty tables give
empty results or no verdicts; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_HOST = 253
#: Actions by precedence on one day.
ACTIONS = {"remove": 0, "allow": 1, "block": 2}


def url_host(url):
    """Lower-cased host of an absolute url, without user and port; empty when there is none."""
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)


def url_segment(url):
    """The first path segment with its slash, when another follows; else empty."""
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://[^/?#]*(/[^/?#]+)/", 1)


def validity(entries: DataFrame) -> DataFrame:
    """key and its intervals: array of (start, stop, action), ``stop`` exclusive and null while it lasts."""
    level = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])
    name = F.create_map(*[F.lit(x) for k, v in ACTIONS.items() for x in (v, k)])
    days = entries.where("key IS NOT NULL AND day IS NOT NULL").select("key", F.col("day").cast("date").alias("start"), F.try_element_at(level, F.col("action")).alias("a")) \
        .where("a IS NOT NULL").groupBy("key", "start").agg(F.max("a").alias("a"))
    spans = days.withColumn("stop", F.lead("start").over(Window.partitionBy("key").orderBy("start"))).where("a > 0")
    return spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "stop", F.element_at(name, F.col("a")).alias("action")))).alias("spans"))


def asked_keys(url):
    """The keys of a url, most specific last: parents from two labels on, the host, the host with its first segment."""
    host, labels = url_host(url), F.split(url_host(url), r"\.")
    parents = F.transform(F.sequence(F.lit(2), F.size(labels)), lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    named = F.when(F.size(labels) >= 2, parents).otherwise(F.array(host))
    deep = F.when(url_segment(url) != "", F.array(F.concat(host, url_segment(url)))).otherwise(F.array().cast("array<string>"))
    return F.when((host != "") & (F.length(host) <= MAX_HOST), F.concat(named, deep)).otherwise(F.array().cast("array<string>"))


def as_of(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, url, fetched, n_active, matched_key, since, verdict of every capture."""
    lists = validity(entries).withColumnRenamed("key", "_key")
    rows = captures.select("page_id", "url", F.col("fetched").cast("date").alias("fetched")).withColumn("row", F.monotonically_increasing_id()) \
        .select("*", F.posexplode_outer(asked_keys(F.col("url"))).alias("depth", "key"))
    day = F.col("fetched")
    hit = F.get(F.filter("spans", lambda x: (x["start"] <= day) & (x["stop"].isNull() | (day < x["stop"]))), F.lit(0))
    met = rows.join(lists, F.col("key") == F.col("_key"), "left").withColumn("hit", hit)
    best = F.max(F.when(F.col("hit").isNotNull(), F.struct("depth", "key", F.col("hit.start").alias("since"), F.col("hit.action").alias("action"))))
    return met.groupBy("row", "page_id", "url", "fetched").agg(F.count("hit").alias("n_active"), best.alias("best")).select(
        "page_id", "url", "fetched", "n_active", F.col("best.key").alias("matched_key"), F.col("best.since").alias("since"),
        F.coalesce("best.action", F.lit("none")).alias("verdict"))


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages as captures: the fetch day follows from the id, over a year."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int")).alias("fetched"))


def entries_of(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts, parent domains and paths of the pages: as many keys as the corpus has.

    Days and actions follow from the first four hex digits of the key's MD5."""
    host = url_host(F.col("url"))
    keys = pages.select(host.alias("host"), url_segment(F.col("url")).alias("seg")).where("host <> ''") \
        .select(F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), key.alias("key")) for kind, key in (
            ("host", F.col("host")), ("parent", F.substring_index("host", ".", -2)), ("path", F.concat("host", "seg")))])).alias("x")).select("x.*").distinct()
    v = F.conv(F.substring(F.md5("key"), 1, 4), 16, 10).cast("int")
    at = lambda shift, kind: F.struct(F.date_add(F.lit("2024-01-01").cast("date"), shift).alias("day"), F.lit(kind).alias("action"))
    dated = F.when(F.col("kind") == "host", F.filter(F.array(
        F.when(v % 2 == 0, at(v % 200, "block")), F.when(v % 4 == 0, at(v % 200 + 40, "remove")), F.when(v % 8 == 0, at(v % 200 + 80, "block"))), lambda x: x.isNotNull())) \
        .when(F.col("kind") == "parent", F.filter(F.array(F.when(v % 3 == 0, at(v % 150, "block")), F.when(v % 3 == 0, at(v % 150 + 90, "allow"))), lambda x: x.isNotNull())) \
        .otherwise(F.filter(F.array(F.when(v % 5 == 0, at(v % 100, "allow"))), lambda x: x.isNotNull()))
    return keys.select("key", F.explode(dated).alias("e")).select("key", "e.day", "e.action")


def pages_as_of(pages: DataFrame) -> DataFrame:
    return as_of(captures_of(pages), entries_of(pages))


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS fetched,
             regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1) AS host,
             regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]*(/[^/?#]+)/', 1) AS seg FROM pages),
k AS (SELECT DISTINCT kind, key FROM (
        SELECT 'host' AS kind, host AS key FROM p WHERE host <> '' UNION ALL
        SELECT 'parent', array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') FROM p WHERE host <> '' UNION ALL
        SELECT 'path', host || seg FROM p WHERE host <> '')),
v AS (SELECT kind, key, CAST('0x' || substr(md5(key), 1, 4) AS INTEGER) AS v FROM k),
e AS (SELECT key, DATE '2024-01-01' + v % 200 AS day, 2 AS a FROM v WHERE kind = 'host' AND v % 2 = 0 UNION ALL
      SELECT key, DATE '2024-01-01' + (v % 200 + 40), 0 FROM v WHERE kind = 'host' AND v % 4 = 0 UNION ALL
      SELECT key, DATE '2024-01-01' + (v % 200 + 80), 2 FROM v WHERE kind = 'host' AND v % 8 = 0 UNION ALL
      SELECT key, DATE '2024-01-01' + v % 150, 2 FROM v WHERE kind = 'parent' AND v % 3 = 0 UNION ALL
      SELECT key, DATE '2024-01-01' + (v % 150 + 90), 1 FROM v WHERE kind = 'parent' AND v % 3 = 0 UNION ALL
      SELECT key, DATE '2024-01-01' + v % 100, 1 FROM v WHERE kind = 'path' AND v % 5 = 0),
s AS (SELECT key, day AS start, a, lead(day) OVER (PARTITION BY key ORDER BY day) AS stop FROM (SELECT key, day, max(a) AS a FROM e GROUP BY ALL)),
q AS (SELECT page_id, url, fetched, host, string_split(host, '.') AS l, seg FROM p),
ask AS (SELECT page_id, fetched, n AS depth, array_to_string(list_slice(l, len(l) - n + 1, len(l)), '.') AS key
          FROM (SELECT page_id, fetched, l, unnest(range(2, len(l) + 1)) AS n FROM q WHERE host <> '' AND length(host) <= 253 AND len(l) >= 2)
        UNION ALL SELECT page_id, fetched, 1, host FROM q WHERE host <> '' AND length(host) <= 253 AND len(l) < 2
        UNION ALL SELECT page_id, fetched, 1000, host || seg FROM q WHERE host <> '' AND length(host) <= 253 AND seg <> ''),
m AS (SELECT page_id, depth, ask.key, start, a FROM ask JOIN s ON ask.key = s.key AND a > 0 AND start <= fetched AND (stop IS NULL OR fetched < stop)),
b AS (SELECT page_id, count(*) AS n, max_by(key, depth) AS key, max_by(start, depth) AS since, max_by(a, depth) AS a FROM m GROUP BY page_id)
SELECT p.page_id, url, fetched, CAST(coalesce(n, 0) AS BIGINT) AS n_active, b.key AS matched_key, since,
       CASE a WHEN 2 THEN 'block' WHEN 1 THEN 'allow' ELSE 'none' END AS verdict
FROM p LEFT JOIN b ON p.page_id = b.page_id
"""
