"""URL filters against dated lists: validity intervals and an as-of join.

List entries are dated changes (``add`` or ``remove`` of a pattern).  Per list and pattern each change holds until the
next, so ``add`` changes become validity intervals.  A capture is looked up under each pattern it could match (its host,
the host's parent domains, and host with leading path parts, as many as the deepest entry has) and under the month it was fetched in; intervals are dealt
into the months they touch, so both sides meet on equal keys and a pattern with a long history, or a host with a third
of the captures, is spread over its months.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

c = F.col


def url_host(url: Column) -> Column:
    """Lower-cased host without user, port and ``www.``; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def url_patterns(url: Column, path_parts: int) -> Column:
    """Patterns that match a URL: host and parent domains of two or more labels, host with 1 .. ``path_parts`` path parts."""
    host = url_host(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
                          lambda i: F.array_join(F.slice(labels, i, F.greatest(F.size(labels), F.lit(1))), "."))
    path = F.regexp_extract(url, r"^[^:]+://[^/?#]*/([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    prefixes = F.transform(F.filter(F.sequence(F.lit(1), F.lit(max(1, path_parts))), lambda i: i <= F.least(F.size(parts), F.lit(path_parts))),
                           lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))
    return F.when(host.isNotNull(), F.array_distinct(F.concat(domains, prefixes)))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """``list, pattern, valid_from, valid_to`` (open end: null) from ``entries(list, pattern, change, changed_at)``.

    Of several changes at one time the removal counts.  Entries without list, pattern or time are left out.
    """
    e = entries.where(c("list").isNotNull() & c("pattern").isNotNull() & c("changed_at").isNotNull())
    e = e.groupBy("list", "pattern", "changed_at").agg(F.min(c("change") == "add").alias("adds"))
    w = W.partitionBy("list", "pattern").orderBy("changed_at")
    e = e.withColumn("was", F.lag("adds").over(w)).where(c("adds") != F.coalesce("was", F.lit(False)))
    e = e.withColumn("valid_to", F.lead("changed_at").over(w))
    return e.where("adds").select("list", "pattern", c("changed_at").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, entries: DataFrame, *, allow: str = "allow") -> DataFrame:
    """One row per distinct ``(page_id, url, fetched_at)`` of ``captures`` with the entries active when it was fetched.

    Returns those columns, ``host``, ``n_active``, ``lists`` and ``patterns`` (sorted, comma-joined) and ``blocked``: some
    list other than ``allow`` has an active entry, and ``allow`` has none.  An interval holds from its start up to, not
    including, its end.  Entries may have any number of path parts.  A null or relative URL, or a null time, matches nothing.  Other columns are ignored.
    """
    months = lambda t: F.year(t) * 12 + F.month(t)
    shots = captures.select("page_id", "url", "fetched_at").distinct()
    span = shots.agg(F.min("fetched_at").alias("a"), F.max("fetched_at").alias("b")).first()
    valid = validity_intervals(entries)
    valid = valid.where((c("valid_from") <= F.lit(span["b"])) & F.coalesce(c("valid_to") > F.lit(span["a"]), F.lit(True)))
    valid = valid.withColumn("month", F.explode(F.sequence(
        months(F.greatest("valid_from", F.lit(span["a"]))), months(F.least(F.coalesce("valid_to", F.lit(span["b"])), F.lit(span["b"]))))))
    deepest = entries.agg(F.max(F.length("pattern") - F.length(F.translate("pattern", "/", "")))).first()[0] or 0
    probes = shots.withColumn("pattern", F.explode(url_patterns(c("url"), deepest))).withColumn("month", months(c("fetched_at")))
    hits = probes.join(valid, ["pattern", "month"]).where((c("fetched_at") >= c("valid_from")) & F.coalesce(c("fetched_at") < c("valid_to"), F.lit(True)))
    found = hits.groupBy("page_id", "url", "fetched_at").agg(
        F.count(F.lit(1)).alias("n"), F.collect_set("list").alias("l"), F.collect_set("pattern").alias("p"))
    found = found.select(c("page_id").alias("_id"), c("url").alias("_url"), c("fetched_at").alias("_at"), "n", "l", "p")
    out = shots.join(found, c("page_id").eqNullSafe(c("_id")) & c("url").eqNullSafe(c("_url")) & c("fetched_at").eqNullSafe(c("_at")), "left")
    none = F.array().cast("array<string>")
    lists = F.coalesce("l", none)
    return out.select("page_id", "url", "fetched_at", url_host(c("url")).alias("host"), F.coalesce("n", F.lit(0)).alias("n_active"),
                      F.array_join(F.array_sort(lists), ",").alias("lists"), F.array_join(F.array_sort(F.coalesce("p", none)), ",").alias("patterns"),
                      ((F.size(F.array_remove(lists, allow)) > 0) & ~F.array_contains(lists, allow)).alias("blocked"))


# The pages table has no fetch times and no lists: both follow from its ids, urls and hosts, in Spark and in SQL alike.
CAPTURED = "timestamp '2023-01-01 00:00:00' + make_interval(0, 0, 0, CAST(page_id * 37 % 730 AS INT), CAST(page_id % 24 AS INT), 0, 0)"


def page_captures(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.expr(CAPTURED).alias("fetched_at"))


def page_entries(pages: DataFrame) -> DataFrame:
    """Entries of three lists on hosts, domains and path prefixes that the pages have, with dates from the pattern's hash."""
    p = pages.select(F.explode(url_patterns(c("url"), 3)).alias("pattern")).distinct()
    x = F.conv(F.substring(F.md5(c("pattern").cast("binary")), 1, 7), 16, 10).cast("int")
    p = p.withColumn("x", x)
    p = p.withColumn("list", F.when(c("x") % 8 == 0, "spam").when(c("x") % 8 == 1, "adult").when(c("x") % 8 == 2, "allow")).where(c("list").isNotNull())
    changes = F.array(*[F.struct(F.lit(name).alias("change"), F.expr(
        f"timestamp '2023-01-01 00:00:00' + make_interval(0, 0, 0, CAST(x DIV 8 % 300 + {k * 150} AS INT), 0, 0, 0)").alias("changed_at"))
        for k, name in enumerate(("add", "remove", "add", "remove"))])
    return p.select("list", "pattern", F.posexplode(changes).alias("k", "e"), "x").where(c("k") <= c("x") % 5).select("list", "pattern", "e.*")


OP7_SQL = r"""
WITH u AS (SELECT DISTINCT page_id, url, TIMESTAMP '2023-01-01' + to_days((page_id * 37 % 730)::INT) + to_hours((page_id % 24)::INT) fetched_at,
  nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', ''), '') host,
  regexp_extract(url, '^[^:]+://[^/?#]*/([^?#]*)', 1) pth FROM pages),
v AS (SELECT *, string_split(host, '.') ls, list_filter(string_split(pth, '/'), lambda x: x <> '') ps FROM u WHERE host IS NOT NULL),
q AS (SELECT page_id, url, fetched_at, unnest(list_distinct(list_concat(
  list_transform(range(1, greatest(len(ls) - 1, 1) + 1), lambda i: array_to_string(ls[i:len(ls)], '.')),
  list_transform(range(1, least(len(ps), 3) + 1), lambda i: host || '/' || array_to_string(ps[1:i], '/'))))) AS pattern FROM v),
pt AS (SELECT pattern, ('0x' || substr(md5(pattern), 1, 7))::BIGINT x FROM (SELECT DISTINCT pattern FROM q)),
en AS (SELECT CASE x % 8 WHEN 0 THEN 'spam' WHEN 1 THEN 'adult' ELSE 'allow' END AS lst, pattern, TIMESTAMP '2023-01-01' + to_days((x // 8 % 300)::INT) b, x % 5 k FROM pt WHERE x % 8 <= 2),
iv AS (SELECT lst, pattern, b f, CASE WHEN k >= 1 THEN b + to_days(150) END t FROM en UNION ALL
  SELECT lst, pattern, b + to_days(300), CASE WHEN k >= 3 THEN b + to_days(450) END FROM en WHERE k >= 2),
hit AS (SELECT q.page_id, q.url, q.fetched_at, lst, q.pattern FROM q JOIN iv ON q.pattern = iv.pattern AND fetched_at >= f AND (t IS NULL OR fetched_at < t)),
g AS (SELECT page_id, url, fetched_at, count(*) n, string_agg(DISTINCT lst, ',' ORDER BY lst) lists, string_agg(DISTINCT pattern, ',' ORDER BY pattern) patterns FROM hit GROUP BY ALL)
SELECT u.page_id, u.url, u.fetched_at, u.host, coalesce(n, 0)::BIGINT n_active, coalesce(lists, '') lists, coalesce(patterns, '') patterns,
  coalesce(lists NOT LIKE '%allow%', false) blocked
FROM u LEFT JOIN g ON u.page_id IS NOT DISTINCT FROM g.page_id AND u.url IS NOT DISTINCT FROM g.url AND u.fetched_at IS NOT DISTINCT FROM g.fetched_at
"""
