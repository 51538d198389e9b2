"""Operator 9: URL filters by a temporal list join. DataFrame functions only, no Python on the rows.

A list is a history of dated entries: at a time, a key (a host, a parent domain, or a host with its
first path segment) is blocked, allowed or cleared. An entry is valid until the next entry of its key
(``intervals``). Every capture is evaluated against the entries that were active when it was fetched;
of several active keys the most specific decides, blocked or allowed.

The as-of join makes no pairs: the distinct (key, time) of the captures and the entries are one
sequence per key, and each takes the last entry at or before it. A key's sequence is cut into spans of
time; the last entry of each span is carried into the later ones, so a hot key's captures and history
are dealt out by (key, span) and met once. Captures are first reduced to distinct (host, segment,
time); the verdicts are then joined back to all rows, of which Spark splits a hot host's.

Defined cases: a null or malformed URL has no host and matches nothing (verdict 'none'); a null time
matches nothing; of entries of a key with the same time, 'block' counts before 'allow' before
'clear', and repeated entries count once; entries with a null key or time are left out; repeated
captures are rows of their own; very long URLs are read as a whole; empty tables give 'none' for all,
or no rows; other columns of the captures are passed through, whatever their names, but columns that
are called host, matched_key, verdict or valid_from are replaced by the results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, fresh, table

#: Scheme and authority; user, port and the dot of a rooted name are taken off the host.
AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#@:]+)"
SEGMENT = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^/?#]+)"
ACTIONS = ("block", "allow", "clear")
#: Length of a span of time, in seconds (or in units of a number).
SPAN = 30 * 86400


def host_of(url):
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(url, AUTHORITY, 1)), r"\.$", ""), F.lit(""))


def segment_of(url):
    return F.nullif(F.regexp_extract(url, SEGMENT, 1), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """entries: key, at, action. key, valid_from, valid_to (exclusive, null: still valid), action."""
    to = F.lead("at").over(W.partitionBy("key").orderBy("at"))
    return changes(entries).select("key", F.col("at").alias("valid_from"), to.alias("valid_to"), "action").where("action <> 'clear'")


def keys_of(host, segment):
    """Array of (key, rank): host with segment, host, then each parent of two labels or more."""
    labels = F.split(host, r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda i: F.struct(F.concat_ws(".", F.slice(labels, i, F.size(labels))).alias("key"), i.cast("int").alias("rank")),
    )
    own = F.struct(F.concat(host, F.lit("/"), F.lower(segment)).alias("key"), F.lit(0).alias("rank"))
    return F.when(segment.isNotNull(), F.concat(F.array(own), parents)).otherwise(parents)


def changes(entries: DataFrame) -> DataFrame:
    """key, at, action: one entry per key and time."""
    rank = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action"))
    one = entries.where("key IS NOT NULL AND at IS NOT NULL AND action IN ('block', 'allow', 'clear')")
    return one.groupBy(F.lower("key").alias("key"), "at").agg(F.min_by("action", rank).alias("action"))


def seconds(at, kind: str):
    """A date, a timestamp or a number as a double that keeps the order."""
    return (at.cast("timestamp") if kind in ("date", "timestamp", "timestamp_ntz") else at).cast("double")


def as_of(points: DataFrame, entries: DataFrame) -> DataFrame:
    """points: distinct (key, at). key, at, action, valid_from of the last entry at or before it, for
    points where that one blocks or allows."""
    span = F.floor(seconds(F.col("at"), dict(points.dtypes)["at"]) / SPAN)
    listed = cut(changes(entries).select("key", "at", F.lit(True).alias("is_entry"), F.struct("at", "action").alias("entry")))
    wanted = points.select("key", "at", F.lit(False).alias("is_entry"), F.lit(None).cast(listed.schema["entry"].dataType).alias("entry"))
    # The last entry of each span, carried over the spans behind it; only spans that have one.
    ends = listed.groupBy("key", span.alias("span")).agg(F.max("entry").alias("entry"))
    until = F.lead("span").over(W.partitionBy("key").orderBy("span"))
    ends = ends.select(F.col("key").alias("k2"), F.col("span").alias("since"), until.alias("until"), F.col("entry").alias("carried"))
    rows = listed.union(wanted).withColumn("span", span)
    inside = W.partitionBy("key", "span").orderBy("at", F.col("is_entry").desc()).rowsBetween(W.unboundedPreceding, 0)
    rows = cut(rows.withColumn("entry", F.last("entry", ignorenulls=True).over(inside)).where("NOT is_entry"))
    here = rows.where("entry IS NOT NULL").select("key", "at", "entry")
    # Points before their span's first entry take the one that is carried into the span.
    spans = rows.where("entry IS NULL").select("key", "span").distinct()
    met = spans.join(ends, (F.col("key") == F.col("k2")) & (F.col("span") > F.col("since")) & (F.col("until").isNull() | (F.col("span") <= F.col("until"))))
    later = rows.where("entry IS NULL").select("key", "at", "span").join(met.select("key", "span", "carried"), ["key", "span"]).select("key", "at", F.col("carried").alias("entry"))
    return here.union(later).where("entry.action <> 'clear'").select("key", "at", "entry.action", F.col("entry.at").alias("valid_from"))


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """All columns of the captures, with host, matched_key, verdict, valid_from."""
    results = ("host", "matched_key", "verdict", "valid_from")
    own = [c for c in captures.columns if c.lower() not in results]
    # Their own names, apart from the captures' columns.
    h, g, t, h2, g2, t2, found = fresh(captures, "_h", "_g", "_t", "_h2", "_g2", "_t2", "_b")
    rows = captures.select(*[F.col(f"`{c}`") for c in own], host_of(F.col(f"`{url}`")).alias(h), segment_of(F.col(f"`{url}`")).alias(g), F.col(f"`{fetched}`").alias(t))
    each = rows.select(F.col(h).alias("_h"), F.col(g).alias("_g"), F.col(t).alias("_t")).where("_h IS NOT NULL AND _t IS NOT NULL").distinct()
    spread = cut(each.select("*", F.explode(keys_of(F.col("_h"), F.col("_g"))).alias("_k")).select("_h", "_g", "_t", "_k.key", "_k.rank"))
    active = as_of(spread.select("key", F.col("_t").alias("at")).distinct(), entries)
    met = spread.join(active, (spread["key"] == active["key"]) & (spread["_t"] == active["at"])).select("_h", "_g", "_t", spread["key"], "rank", "action", "valid_from")
    best = met.groupBy("_h", "_g", "_t").agg(F.min_by(F.struct("key", "action", "valid_from"), "rank").alias(found))
    best = best.select(F.col("_h").alias(h2), F.coalesce("_g", F.lit("/")).alias(g2), F.col("_t").alias(t2), found)
    out = rows.join(best, (F.col(h) == F.col(h2)) & (F.coalesce(g, F.lit("/")) == F.col(g2)) & (F.col(t) == F.col(t2)), "left")
    b = F.col(found)
    verdict = F.coalesce(b["action"], F.lit("none"))
    return out.select(*[F.col(f"`{c}`") for c in own], F.col(h).alias("host"), b["key"].alias("matched_key"), verdict.alias("verdict"), b["valid_from"].alias("valid_from"))


def stand_in(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tables have no list and no fetch times: both are derived by rule. A page is fetched on
    day page_id mod 366 of 2024. From the digits of its md5, a host is blocked and cleared again,
    blocked and later allowed, or blocked in one folder; so are some parent domains."""
    start = F.lit("2024-01-01").cast("date")
    captures = pages.select("page_id", "url", F.date_add(start, F.pmod("page_id", F.lit(366)).cast("int")).alias("fetched"))
    hosts = pages.select(host_of(F.col("url")).alias("host"), segment_of(F.col("url")).alias("segment")).where("host IS NOT NULL").distinct()
    digits = lambda c, at: F.conv(F.substring(F.md5(c.cast("binary")), at, 4), 16, 10).cast("int")
    h = hosts.select("host", "segment", digits(F.col("host"), 1).alias("a"), digits(F.col("host"), 5).alias("b"))
    entry = lambda key, day, action: F.struct(key.alias("key"), F.date_add(start, day.cast("int")).alias("at"), F.lit(action).alias("action"))
    a, b, kind, host = F.col("a"), F.col("b"), F.col("a") % 8, F.col("host")
    parent = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    rows = F.array(
        F.when(kind == 0, entry(host, b % 300, "block")),
        F.when(kind == 0, entry(host, b % 300 + 40 + a % 90, "clear")),
        F.when(kind == 1, entry(host, b % 200, "block")),
        F.when(kind == 1, entry(host, b % 200 + 60, "allow")),
        F.when((kind == 2) & F.col("segment").isNotNull(), entry(F.concat(host, F.lit("/"), F.col("segment")), b % 300, "block")),
        F.when((kind == 3) & (parent != ""), entry(parent, F.lit(100), "block")),
        F.when((kind == 3) & (parent != ""), entry(parent, F.lit(110), "clear")),
    )
    return captures, h.select(F.explode(rows).alias("e")).where("e IS NOT NULL").select("e.*").distinct()


def op9(spark, sf_dir: str) -> DataFrame:
    captures, entries = stand_in(table(spark, sf_dir, "pages").select("page_id", "url"))
    out = evaluate(captures, entries)
    return out.select("page_id", "host", F.col("fetched").cast("string").alias("fetched"), "matched_key", "verdict", F.col("valid_from").cast("string").alias("valid_from"))


OP9_SQL = r"""
WITH p AS (
  SELECT page_id, CAST(DATE '2024-01-01' + CAST(((page_id % 366) + 366) % 366 AS INTEGER) AS DATE) AS fetched,
         nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#@:]+)', 1)), '\.$', ''), '') AS host,
         nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^/?#]+)', 1), '') AS segment
  FROM pages
), h AS (
  SELECT DISTINCT host, segment, CAST('0x' || substr(md5(host), 1, 4) AS INTEGER) AS a, CAST('0x' || substr(md5(host), 5, 4) AS INTEGER) AS b,
         regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS parent
  FROM p WHERE host IS NOT NULL
), e AS (
  SELECT host AS key, b % 300 AS d, 'block' AS action FROM h WHERE a % 8 = 0
  UNION SELECT host, b % 300 + 40 + a % 90, 'clear' FROM h WHERE a % 8 = 0
  UNION SELECT host, b % 200, 'block' FROM h WHERE a % 8 = 1
  UNION SELECT host, b % 200 + 60, 'allow' FROM h WHERE a % 8 = 1
  UNION SELECT host || '/' || segment, b % 300, 'block' FROM h WHERE a % 8 = 2 AND segment IS NOT NULL
  UNION SELECT parent, 100, 'block' FROM h WHERE a % 8 = 3 AND parent <> ''
  UNION SELECT parent, 110, 'clear' FROM h WHERE a % 8 = 3 AND parent <> ''
), e1 AS (
  SELECT lower(key) AS key, CAST(DATE '2024-01-01' + CAST(d AS INTEGER) AS DATE) AS since,
         arg_min(action, CASE action WHEN 'block' THEN 1 WHEN 'allow' THEN 2 ELSE 3 END) AS action
  FROM e GROUP BY ALL
), v AS (
  SELECT key, since AS valid_from, lead(since) OVER (PARTITION BY key ORDER BY since) AS valid_to, action FROM e1
), keys AS (
  SELECT DISTINCT host, segment, fetched, host || '/' || lower(segment) AS key, 0 AS rank FROM p WHERE host IS NOT NULL AND segment IS NOT NULL
  UNION SELECT host, segment, fetched, array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.'), i
  FROM p, unnest(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1)) AS r(i) WHERE host IS NOT NULL
), best AS (
  SELECT k.host, k.segment, k.fetched, arg_min(k.key, rank) AS matched_key, arg_min(action, rank) AS verdict, arg_min(valid_from, rank) AS valid_from
  FROM keys k JOIN v ON k.key = v.key AND k.fetched >= v.valid_from AND (v.valid_to IS NULL OR k.fetched < v.valid_to)
  WHERE v.action <> 'clear' GROUP BY 1, 2, 3
)
SELECT p.page_id, p.host, CAST(p.fetched AS VARCHAR) AS fetched, b.matched_key, coalesce(b.verdict, 'none') AS verdict, CAST(b.valid_from AS VARCHAR) AS valid_from
FROM p LEFT JOIN best b ON p.host = b.host AND p.segment IS NOT DISTINCT FROM b.segment AND p.fetched = b.fetched
"""
