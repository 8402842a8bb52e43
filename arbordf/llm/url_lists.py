"""URL filters by a temporal list join, in DataFrame operations only.

A list is a table of dated entries (pattern, action, effective): from ``effective`` on the pattern blocks, allows, or is
taken off ("remove"). Entries become validity intervals: each lasts until the next entry of its pattern, so that at most
one is active at any time. A pattern is a host, a parent domain of two labels or more, or a host with the first segments
of a path (``host/a/b``, any number of them). Hosts compare without case, paths with it.

Every capture is looked up by its few possible patterns and joined as of its fetch time: equal pattern, and the interval
holds the time. The most specific active pattern decides (longest; of equal ones the later effective date, then the
greater pattern). The list is joined by the planner's own choice: broadcast only while its size is below the session's
threshold, else by a sort-merge join whose skewed hosts adaptive execution splits. The intervals are written once in the
shared folder.

User information and port of a URL do not count; nor do query, fragment and slashes at the end of an entry. A null or
malformed URL, a null fetch time, or no active entry gives the verdict "none". Entries with a null pattern or date are
ignored, as are actions other than the three; of several entries of a pattern on one date the last action in the order
allow, block, remove holds. Every capture has its row, equal ones as well. Empty tables give no rows, or "none"
everywhere. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table

_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/:?#]+)"
_PATH = r"^[^:/?#]+://[^/?#]*/([^?#]*)"


def normal_pattern(pattern: Column) -> Column:
    """Host without case, path as it is, no slashes at the end."""
    bare = F.regexp_replace(pattern, "/+$", "")
    host = F.substring_index(bare, "/", 1)
    return F.concat(F.lower(host), F.substr(bare, F.length(host) + 1))


def validity(entries: DataFrame) -> DataFrame:
    """(pattern, action, valid_from, valid_to) of dated entries; valid_to is null for the last one of a pattern."""
    known = entries.filter(F.col("pattern").isNotNull() & F.col("effective").isNotNull() & F.col("action").isin("allow", "block", "remove"))
    once = known.groupBy(normal_pattern(F.col("pattern")).alias("pattern"), "effective").agg(F.max("action").alias("action"))
    until = F.lead("effective").over(Window.partitionBy("pattern").orderBy("effective"))
    spans = once.select("pattern", "action", F.col("effective").alias("valid_from"), until.alias("valid_to"))
    return spans.filter(F.col("action").isin("allow", "block"))


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit(""))


def patterns_of(url: Column, depth: int) -> Column:
    """The host with its first 1 to ``depth`` path segments, the host, and its parent domains of two labels or more."""
    host = host_of(url)
    labels, segments = F.split(host, r"\."), F.split(F.regexp_extract(url, _PATH, 1), "/")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    if depth < 1:
        return F.when(host.isNotNull(), parents)
    starts = F.transform(F.sequence(F.lit(1), F.least(F.size(segments), F.lit(depth))), lambda i: F.array_join(F.slice(segments, 1, i), "/"))
    paths = F.transform(F.filter(starts, lambda x: (x != "") & ~F.endswith(x, F.lit("/"))), lambda x: F.concat(host, F.lit("/"), x))
    return F.when(host.isNotNull(), F.concat(paths, parents))


def deepest(entries: DataFrame) -> int:
    """Most path segments of an entry: one number."""
    path = F.regexp_replace("pattern", "/+$", "")
    return entries.agg(F.max(F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))))).first()[0] or 0


def filter_captures(captures: DataFrame, entries: DataFrame, depth: int | None = None) -> DataFrame:
    """(key, url, fetched) rows to key, host, fetched, n_active, pattern, verdict and kept.

    ``depth`` is the number of path segments that entries have at most; if not given it is looked up first."""
    depth = deepest(entries) if depth is None else depth
    keyed = captures.select("key", "url", "fetched", F.posexplode_outer(patterns_of(F.col("url"), depth)).alias("at", "pattern"))
    # written once, so that a join of large sides starts with an exchange of each, which skew handling can split
    spans = materialize(validity(entries), "spans")
    active = (keyed["pattern"] == spans["pattern"]) & (keyed["fetched"] >= spans["valid_from"]) & (spans["valid_to"].isNull() | (keyed["fetched"] < spans["valid_to"]))
    hit = F.when(spans["pattern"].isNotNull(), F.struct(F.length(spans["pattern"]).alias("size"), spans["valid_from"], spans["pattern"], spans["action"]))
    joined = keyed.join(spans, active, "left").select("key", "url", "fetched", "at", hit.alias("hit"))
    # a pattern has one active interval at most, so the first pattern of each capture counts the equal captures
    copies = F.count_if(F.coalesce("at", F.lit(0)) == 0)
    best = joined.groupBy("key", "url", "fetched").agg(copies.alias("copies"), F.count("hit").alias("hits"), F.max("hit").alias("hit"))
    verdict = F.coalesce("hit.action", F.lit("none"))
    out = best.select("key", "url", "fetched", "hit", (F.col("hits") / F.col("copies")).cast("long").alias("n_active"), F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return out.select("key", host_of(F.col("url")).alias("host"), "fetched", "n_active", F.col("hit.pattern").alias("pattern"), verdict.alias("verdict"), (verdict != "block").alias("kept"))


def derived_entries(pages: DataFrame, depth: int = 2) -> DataFrame:
    """A dated list for ``pages`` (url): up to three entries for every host, parent domain and path start that occurs,
    chosen, dated (in 2024) and given an action by the digits of a hash."""
    patterns = pages.select(F.explode(patterns_of(F.col("url"), depth)).alias("pattern")).distinct()
    digest = F.md5(F.concat("pattern", F.lit("#"), F.col("turn").cast("string")))

    def digit(i: int) -> Column:
        return F.instr(F.lit("0123456789abcdef"), F.substr(digest, F.lit(i), F.lit(1))) - 1

    dealt = patterns.withColumn("turn", F.explode(F.array(*(F.lit(k) for k in (1, 2, 3))))).filter(digit(1) < 6)
    action = F.when(digit(2) < 8, "block").when(digit(2) < 13, "allow").otherwise("remove")
    return dealt.select("pattern", action.alias("action"), F.timestamp_seconds(F.lit(1704067200) + (digit(3) * 16 + digit(4)) * 86400).alias("effective"))


def op3_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` hold no fetch time: page_id stands for one, 37 minutes apart through 2024. The list is derived from the
    pages' own hosts and paths and grows with them."""
    pages = read_table(spark, sf_dir, "pages")
    fetched = F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("page_id") * 37, F.lit(366 * 1440)) * 60)
    out = filter_captures(pages.select(F.col("page_id").alias("key"), "url", fetched.alias("fetched")), derived_entries(pages), depth=2)
    return out.select(F.col("key").alias("page_id"), "host", F.date_format("fetched", "yyyy-MM-dd HH:mm").alias("fetched"), "n_active", "pattern", "verdict", "kept")


OP3_SQL = r"""
WITH captures AS (
  SELECT row_number() OVER () AS rid, page_id, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST((page_id * 37) % (366 * 1440) AS BIGINT)) AS fetched,
    nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/:?#]+)', 1)), '') AS host,
    regexp_extract(url, '^[^:/?#]+://[^/?#]*/([^?#]*)', 1) AS path
  FROM pages
),
cut AS (SELECT *, split_part(path, '/', 1) AS one, split_part(path, '/', 2) AS two, string_split(host, '.') AS labels FROM captures),
patterns AS (
  SELECT host || '/' || one AS pattern FROM cut WHERE one <> ''
  UNION SELECT host || '/' || one || '/' || two FROM cut WHERE two <> ''
  UNION SELECT array_to_string(labels[i:], '.') FROM (SELECT labels, unnest(range(1, greatest(len(labels), 2))) AS i FROM cut WHERE host IS NOT NULL)
),
digits AS (SELECT pattern, list_transform(range(1, 5), lambda i: strpos('0123456789abcdef', substr(md5(pattern || '#' || turn), i, 1)) - 1) AS d
  FROM patterns, (VALUES ('1'), ('2'), ('3')) AS t(turn) WHERE pattern IS NOT NULL),
entries AS (SELECT pattern, CASE WHEN d[2] < 8 THEN 'block' WHEN d[2] < 13 THEN 'allow' ELSE 'remove' END AS action,
  TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(d[3] * 16 + d[4] AS INTEGER)) AS effective FROM digits WHERE d[1] < 6),
once AS (SELECT pattern, effective, max(action) AS action FROM entries GROUP BY ALL),
latest AS (  -- of each pattern that fits a capture, the last entry before the fetch
  SELECT c.rid, o.pattern, max(o.effective) AS valid_from, max_by(o.action, o.effective) AS action
  FROM cut c JOIN once o ON o.effective <= c.fetched AND (
    o.pattern = c.host OR (len(c.labels) > 2 AND ends_with(c.host, '.' || o.pattern) AND contains(o.pattern, '.')) OR (c.one <> '' AND o.pattern = c.host || '/' || c.one)
    OR (c.two <> '' AND o.pattern = c.host || '/' || c.one || '/' || c.two))
  GROUP BY ALL
),
best AS (
  SELECT rid, count(*) AS n_active, max_by(pattern, (length(pattern), valid_from, pattern)) AS pattern, max_by(action, (length(pattern), valid_from, pattern)) AS action
  FROM latest WHERE action <> 'remove' GROUP BY 1
)
SELECT page_id, host, strftime(fetched, '%Y-%m-%d %H:%M') AS fetched, coalesce(n_active, 0) AS n_active, pattern, coalesce(action, 'none') AS verdict, coalesce(action, 'none') <> 'block' AS kept
FROM captures LEFT JOIN best USING (rid)
"""
