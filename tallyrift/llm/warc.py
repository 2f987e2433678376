"""Not-modified revisits of an archive, resolved to the responses they stand for.

A revisit (304) has no body. It stands for the latest earlier full response of the same
canonical URL, if the validators agree: entity tags (compared without the weak mark) when
the revisit has one, else the modification date when it has one, else any. The resolved
headers are those of the full response, replaced by the revisit's where that is permitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyrift.llm.common import share
from tallyrift.session import materialize

RANGE_ROWS, MOST_RANGES = 20_000, 1 << 20
# Fixed: fields of a 304 that describe the connection or a body, not the stored response.
NOT_MERGED = (
    "connection keep-alive proxy-authenticate proxy-authorization proxy-connection te trailer transfer-encoding upgrade "
    "content-encoding content-length content-range content-type"
).split()
# Fixed: query parameters that only say where a visitor came from.
TRACKING = "utm_[a-z]+|gclid|fbclid|msclkid|ref|sessionid"


def canonical_url(url: Column) -> Column:
    """Host in lower case without default port, path, and query without tracking parameters;
    no scheme, no fragment, no trailing slash."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), ":(80|443)$", "")
    rest = F.regexp_replace(bare, "^[^/?]*", "")
    rest = F.regexp_replace(rest, f"([?&])(({TRACKING})=[^&]*(&|$))+", "$1")
    return F.concat(host, F.regexp_replace(F.regexp_replace(rest, "[?&]+$", ""), "/+$", ""))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``record_id, canonical_url, refers_to, outcome, headers`` of every revisit.

    ``records`` has ``record_id, url, time`` (bigint), ``status, etag, last_modified`` and
    ``headers`` (map, names in lower case). Status 304 is a revisit, 200 a full response,
    others are neither. ``outcome`` is ``resolved``, ``changed`` (validators differ; nothing
    older is tried) or ``missing`` (no earlier response, no url or no time); headers are null
    unless resolved. Of responses at one time the largest id counts; a response at the
    revisit's own time is not earlier. Repeated rows are answered alike; no rows give none.

    Time is cut into ranges of about RANGE_ROWS records. Inside a range a window finds the
    response; what a range inherits is the last response of an earlier range, found among one
    row per URL and range. A URL with most of the records is so spread over its ranges."""
    entries = F.array_sort(F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>"))))
    rows = records.where(F.col("status").isin(200, 304)).select(
        "record_id", "time", "etag", "last_modified", "status", canonical_url(F.col("url")).alias("canonical_url"), entries.alias("entries")
    )
    known = rows.agg(F.count(F.lit(1)), F.min("time"), F.max("time")).first()
    width = 1 if known[1] is None else max(1, -(-(known[2] - known[1] + 1) // share(known[0], RANGE_ROWS, MOST_RANGES)))
    full = F.when((F.col("status") == 200) & F.col("time").isNotNull(), F.struct("time", "record_id", "etag", "last_modified", "entries"))
    rows = rows.withColumn("_range", F.floor(F.col("time") / F.lit(width))).withColumn("_full", full)
    last = rows.groupBy("canonical_url", "_range").agg(F.max("_full").alias("_last"))
    before = Window.partitionBy("canonical_url").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    inherited = last.select("canonical_url", "_range", F.max("_last").over(before).alias("_inherited"))
    inherited = materialize(inherited.where("_inherited is not null and canonical_url is not null"), "inherited")
    earlier = Window.partitionBy("canonical_url", "_range").orderBy("time").rangeBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("_seen", F.max("_full").over(earlier)).where("status = 304")
    found = seen.join(inherited, ["canonical_url", "_range"], "left")
    found = found.withColumn("_full", F.when(F.col("canonical_url").isNotNull() & F.col("time").isNotNull(), F.coalesce("_seen", "_inherited")))
    same = (
        F.when(F.col("etag").isNotNull(), _weak(F.col("etag")).eqNullSafe(_weak(F.col("_full.etag"))))
        .when(F.col("last_modified").isNotNull(), F.col("last_modified").eqNullSafe(F.col("_full.last_modified")))
        .otherwise(F.lit(True))
    )
    outcome = F.when(F.col("_full").isNull(), "missing").when(same, "resolved").otherwise("changed")
    new = F.filter("entries", lambda e: ~e["key"].isin(NOT_MERGED))
    kept = F.filter("_full.entries", lambda e: ~F.array_contains(F.transform("_new", lambda n: n["key"]), e["key"]))
    merged = F.map_from_entries(F.array_sort(F.concat(kept, F.col("_new"))))
    return (
        found.withColumn("outcome", outcome)
        .withColumn("_new", new)
        .select(
            "record_id", "canonical_url", F.col("_full.record_id").alias("refers_to"), "outcome",
            F.when(F.col("outcome") == "resolved", merged).alias("headers"),
        )
    )


def page_records(pages: DataFrame) -> DataFrame:
    """An archive of three visits to every page: a full response, a revisit 500 ticks later
    and one 1,000 ticks before or after it. One page in five had changed by its last visit."""
    id_, tag = F.col("page_id"), F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    size = F.length(F.coalesce("html", F.lit(""))).cast("string")

    def visit(number: int, time: Column, status: int, etag: Column, *headers: Column) -> Column:
        return F.struct(
            (id_ * 3 + number).alias("record_id"), time.alias("time"), F.lit(status).alias("status"), etag.alias("etag"),
            F.lit(None).cast("string").alias("last_modified"), F.create_map(*headers, F.lit("date"), time.cast("string"), F.lit("etag"), etag).alias("headers"),
        )

    changed = F.when(id_ % 5 == 0, F.lit('"new"')).otherwise(F.concat(F.lit("W/"), tag))
    last = id_ * 7 + F.when(id_ % 4 == 0, -1000).otherwise(1000)
    visits = F.array(
        visit(0, id_ * 7, 200, tag, F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), size),
        visit(1, id_ * 7 + 500, 304, tag, F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=60")),
        visit(2, last, 304, changed, F.lit("connection"), F.lit("close")),
    )
    return pages.select("url", F.explode(visits).alias("visit")).select("url", "visit.*")


REVISITS_SQL = f"""
WITH bare AS (
  SELECT page_id, coalesce(html, '') AS html,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS b FROM pages
), parts AS (
  SELECT page_id, html, regexp_replace(lower(regexp_extract(b, '^([^/?]*)', 1)), ':(80|443)$', '') AS host,
         regexp_replace(regexp_replace(b, '^[^/?]*', ''), '([?&])(({TRACKING})=[^&]*(&|$))+', '\\1', 'g') AS rest FROM bare
), visits AS (
  SELECT page_id, html, host || regexp_replace(regexp_replace(rest, '[?&]+$', ''), '/+$', '') AS canonical_url,
         '"' || md5(html) || '"' AS tag FROM parts
), full_ AS (
  SELECT page_id * 3 AS record_id, canonical_url, page_id * 7 AS t, tag, length(html) AS size FROM visits
), revisits AS (
  SELECT page_id * 3 + 1 AS record_id, canonical_url, page_id * 7 + 500 AS t, tag, 'cache-control=max-age=60;' AS cache FROM visits
  UNION ALL
  SELECT page_id * 3 + 2, canonical_url, page_id * 7 + CASE WHEN page_id % 4 = 0 THEN -1000 ELSE 1000 END,
         CASE WHEN page_id % 5 = 0 THEN '"new"' ELSE 'W/' || tag END, '' FROM visits
), met AS (
  SELECT r.*, f.record_id AS refers_to, f.tag AS full_tag, f.size
  FROM revisits r LEFT JOIN full_ f ON r.canonical_url = f.canonical_url AND f.t < r.t
  QUALIFY row_number() OVER (PARTITION BY r.record_id ORDER BY f.t DESC NULLS LAST, f.record_id DESC) = 1
), answered AS (
  SELECT *, CASE WHEN refers_to IS NULL THEN 'missing' WHEN regexp_replace(tag, '^W/', '') = full_tag THEN 'resolved' ELSE 'changed' END AS outcome FROM met
)
SELECT record_id, canonical_url, refers_to, outcome,
       CASE WHEN outcome = 'resolved' THEN cache || 'content-length=' || size || ';content-type=text/html;date=' || t || ';etag=' || tag END AS headers
FROM answered
"""
