"""URL filters: dated list entries become validity intervals, joined as of each capture's fetch time.

An entry adds a pattern to a list or removes it, from its date on. A pattern is a domain, which covers the hosts
below it, or a host with a path, which covers the paths below that; so a capture can only match its own host and path
prefixes, and the join is by equality on those, with the interval as a condition. Where the intervals are few, they
are broadcast, after their number was counted; beyond that both sides are shuffled by pattern, and AQE
splits the hot hosts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemmata.session import small

_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#:@\[\]]+)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)"


def host(url: Column) -> Column:
    """The lower-case host, without a final dot, an IPv6 address in its brackets; null where there is none."""
    h = F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"\.+$", "")
    return F.when(h != "", h)


def intervals(entries: DataFrame) -> DataFrame:
    """(list, pattern, valid_from, valid_to): when each pattern was on each list; ``valid_to`` is null while it still is.

    ``entries(list, pattern, action, at)`` with actions ``add`` and ``remove``; patterns lose case, blanks around
    and slashes at the end. Entries with a null, or another action, are left out. Of entries at the same moment
    ``remove`` is the last; adding what is there, or removing what isn't, changes nothing.
    """
    e = entries.select("list", F.regexp_replace(F.lower(F.trim("pattern")), "/+$", "").alias("pattern"), F.lower("action").alias("action"), "at")
    e = e.where("list IS NOT NULL AND pattern <> '' AND at IS NOT NULL AND action IN ('add', 'remove')")
    # one state for each moment, then only its changes
    e = e.groupBy("list", "pattern", "at").agg(F.min(F.when(F.col("action") == "add", 1).otherwise(0)).alias("on"))
    w = Window.partitionBy("list", "pattern").orderBy("at")
    e = e.withColumn("was", F.coalesce(F.lag("on").over(w), F.lit(0))).where("on <> was")
    e = e.withColumn("valid_to", F.lead("at").over(w))
    return e.where("on = 1").select("list", "pattern", F.col("at").alias("valid_from"), "valid_to")


def as_of(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(page_id, host, fetched_at, list, pattern, listed_since, decision) of each row of ``captures(page_id, url, fetched_at)``.

    The longest pattern that was active at the fetch time decides, of equals the list that sorts first (``allow``
    before ``block``): ``decision`` is its list, or ``none``. A capture without a host or a time matches nothing. A
    moment belongs to the interval that begins then. Repeated rows are one capture each; a null page_id stays null; urls of any length are
    taken whole; without captures there are no rows, without entries all decisions are ``none``; other columns are ignored.
    """
    spans = intervals(entries).withColumnRenamed("pattern", "key")
    path = F.regexp_replace(F.lower(F.regexp_extract("url", _PATH, 1)), "/+$", "")
    c = captures.select("page_id", host(F.col("url")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), "fetched_at")
    # equal hosts, paths and times have equal answers, so those are the key: a lost task may be run again in any order
    key = ["host", "path", "fetched_at"]
    labels, parts = F.split("host", r"\."), F.split("path", "/")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    paths = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.concat("host", F.array_join(F.slice(parts, F.lit(1), k), "/")))
    )
    asked = c.where("host IS NOT NULL AND fetched_at IS NOT NULL").select(*key).distinct().select(*key, F.explode(F.array_distinct(F.concat(domains, paths))).alias("key"))
    n = spans.count()
    hits = asked.join(small(spans, n, 200), "key").where("fetched_at >= valid_from AND (valid_to IS NULL OR fetched_at < valid_to)")
    best = hits.groupBy(*key).agg(F.min(F.struct((-F.length("key")).alias("n"), F.col("list"), F.col("key"), F.col("valid_from"))).alias("b"))
    return c.join(best, key, "left").select(
        "page_id", "host", "fetched_at", F.col("b.list").alias("list"), F.col("b.key").alias("pattern"), F.col("b.valid_from").alias("listed_since"), F.coalesce("b.list", F.lit("none")).alias("decision")
    )


# The tables have pages but neither fetch times nor lists, so both are derived from what is there: pages are
# fetched over two years, and each host, some parent domains and some paths are listed and unlisted at times given by a digest.
_DAY0 = "2023-01-01 00:00:00"


def dated_captures(pages: DataFrame) -> DataFrame:
    """(page_id, url, fetched_at): a fetch time for each page, by the digest of its url and page_id; none where either is null. Equal rows get equal times."""
    digest = F.md5(F.concat(F.col("page_id").cast("string"), F.lit(" "), F.col("url")))
    minutes = F.conv(F.substring(digest, 1, 5), 16, 10).cast("int")
    return pages.select("page_id", "url", (F.lit(_DAY0).cast("timestamp") + F.make_interval(mins=minutes)).alias("fetched_at"))


def dated_entries(pages: DataFrame) -> DataFrame:
    """(list, pattern, action, at) for the hosts of ``pages``, their parent domains and the first parts of their paths, each pattern once; urls that are null or have no host give none."""
    h = host(F.col("url"))
    path = F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.\-]*://[^/?#]*(/[^/?#]+)", 1)
    hosts = pages.select(h.alias("host"), path.alias("path")).where("host IS NOT NULL")
    patterns = hosts.select(F.explode(F.array(F.col("host"), F.regexp_replace("host", r"^[^.]+\.", ""), F.concat("host", "path"))).alias("pattern")).distinct()
    digest = F.md5("pattern")
    number = lambda at: F.conv(F.substring(digest, at, 2), 16, 10).cast("int")
    event = lambda action, hours: F.struct(F.lit(action).alias("action"), hours.alias("hours"))
    events = F.array(event("add", number(3) * 30), event("remove", (number(3) + number(5)) * 30), event("add", (number(3) + number(5) + number(7)) * 30))
    named = patterns.where(number(1) < 160).select(F.when(number(1) < 40, "allow").otherwise("block").alias("list"), "pattern", F.explode(events).alias("e"))
    return named.select("list", "pattern", "e.action", (F.lit(_DAY0).cast("timestamp") + F.make_interval(hours=F.col("e.hours"))).alias("at"))


SQL = r"""
WITH p AS (
  SELECT page_id, url, row_number() OVER () AS row_id,
    nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#:@\[\]]+)', 1)), '\.+$', ''), '') AS host,
    regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://[^/?#]*(/[^/?#]+)', 1) AS first_part,
    regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)', 1)), '/+$', '') AS path,
    TIMESTAMP '2023-01-01 00:00:00' + to_minutes(CAST('0x' || substr(md5(page_id || ' ' || url), 1, 5) AS BIGINT)) AS fetched_at
  FROM pages
), patterns AS (
  SELECT host AS pattern FROM p WHERE host IS NOT NULL
  UNION SELECT regexp_replace(host, '^[^.]+\.', '') FROM p WHERE host IS NOT NULL
  UNION SELECT host || first_part FROM p WHERE host IS NOT NULL
), digests AS (
  SELECT pattern, CAST('0x' || substr(md5(pattern), 1, 2) AS BIGINT) AS a, CAST('0x' || substr(md5(pattern), 3, 2) AS BIGINT) AS b,
    CAST('0x' || substr(md5(pattern), 5, 2) AS BIGINT) AS c, CAST('0x' || substr(md5(pattern), 7, 2) AS BIGINT) AS d
  FROM patterns
), entries AS (
  SELECT CASE WHEN a < 40 THEN 'allow' ELSE 'block' END AS list, pattern, unnest(['add', 'remove', 'add']) AS action,
    TIMESTAMP '2023-01-01 00:00:00' + to_hours(30 * unnest([b, b + c, b + c + d])) AS moment
  FROM digests WHERE a < 160
), states AS (
  SELECT list, pattern, moment, min(CASE WHEN action = 'add' THEN 1 ELSE 0 END) AS is_on FROM entries GROUP BY ALL
), changes AS (
  SELECT * FROM states QUALIFY is_on <> coalesce(lag(is_on) OVER (PARTITION BY list, pattern ORDER BY moment), 0)
), spans AS (
  SELECT list, pattern, is_on, moment AS valid_from, lead(moment) OVER (PARTITION BY list, pattern ORDER BY moment) AS valid_to FROM changes
), hits AS (
  SELECT p.row_id, s.list, s.pattern, s.valid_from
  FROM p JOIN spans s ON s.is_on = 1 AND p.fetched_at >= s.valid_from AND (s.valid_to IS NULL OR p.fetched_at < s.valid_to)
    AND (p.host = s.pattern OR ends_with(p.host, '.' || s.pattern) OR p.host || p.path = s.pattern OR starts_with(p.host || p.path, s.pattern || '/') AND contains(s.pattern, '/'))
  QUALIFY row_number() OVER (PARTITION BY p.row_id ORDER BY length(s.pattern) DESC, s.list, s.pattern, s.valid_from) = 1
)
SELECT p.page_id, p.host, p.fetched_at, h.list, h.pattern, h.valid_from AS listed_since, coalesce(h.list, 'none') AS decision
FROM p LEFT JOIN hits h USING (row_id)
"""
