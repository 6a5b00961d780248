"""Link-graph and robots jobs over stored tables; every join has an equality key."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.exprs import entries, rx, rx_sub
from ..session import checkpoint_ready
from .skew import first_k, salted_lookup

c = F.col


def link_edges(signals: DataFrame) -> DataFrame:
    """``site, src_page_id, src_url, dst_url, internal``."""
    return signals.select(
        "site", c("page_id").alias("src_page_id"), c("url").alias("src_url"), F.explode(entries("links")).alias("l")
    ).select("site", "src_page_id", "src_url", c("l.url").alias("dst_url"), c("l.internal").alias("internal"))


def link_counts(signals: DataFrame) -> DataFrame:
    return signals.select("page_id", "site", "n_internal", "n_external")


# --- robots --------------------------------------------------------------------------------------
def _rule_regex(rule: Column) -> Column:
    """Anchored regex of a rule with wildcards; all other characters are quoted."""
    quoted = rx_sub(rule, r"([\\.\[\]{}()+?^$|])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("$"))


def robots_blocked(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Pages whose path a disallow rule of their host blocks: prefix, or anchored pattern for rules with ``*``.

    ``rules(host, kind, value)`` comes from ``robots_rules`` and stays one row per rule, however many a host has.  A path is
    cut at each length that a prefix rule of its host has, and the pieces are looked up as exact keys; rules with wildcards, few
    as a rule, are tried one by one.  Each blocked page comes once.
    """
    useful = rules.where((c("kind") == "disallow") & ~c("value").isin("", "/")).select("host", "value").distinct()
    wild = useful.where(c("value").contains("*")).select("host", _rule_regex(c("value")).alias("pattern"))
    prefixes = useful.where(~c("value").contains("*")).select("host", c("value").alias("piece"))
    lengths = prefixes.select("host", F.length("piece").alias("n")).groupBy("host").agg(F.collect_set("n").alias("_lengths"))
    located = pages.select("page_id", "url", U.host_of("url").alias("host"),
                           F.coalesce(F.nullif(U.path_of("url"), F.lit("")), F.lit("/")).alias("path"))
    cut = located.join(lengths, "host").select("*", F.explode(F.filter("_lengths", lambda n: n <= F.length("path"))).alias("_n"))
    by_prefix = cut.withColumn("piece", F.substring("path", F.lit(1), c("_n"))).join(prefixes, ["host", "piece"], "left_semi")
    by_pattern = located.alias("x").join(wild.alias("w"), (c("x.host") == c("w.host")) & F.rlike("x.path", "w.pattern"), "left_semi")
    out = ["page_id", "url", "host", "path"]
    return by_prefix.select(*out).unionByName(by_pattern.select(*out)).distinct()


# --- crawl graph ---------------------------------------------------------------------------------
def _sitemap_last() -> Column:
    return F.when(F.lower("url").contains("sitemap") | F.endswith("url", F.lit(".xml")), 1).otherwise(0)


def frontier(edges: DataFrame, visited: DataFrame, max_pages: int = 100) -> DataFrame:
    """Internal targets not visited yet, content links before sitemap links, at most the site's open budget."""
    wanted = edges.where("internal").groupBy("site", c("dst_url").alias("url")).agg(
        F.min("src_page_id").alias("first_seen_on"))
    seen = visited.select("site", "url").distinct()
    fresh = wanted.join(seen, ["site", "url"], "left_anti")
    ranked = fresh.withColumn("priority", _sitemap_last())
    used = seen.groupBy("site").agg(F.count(F.lit(1)).alias("_used"))
    top = first_k(ranked, ["site"], ["priority", "first_seen_on", "url"], max_pages, "url")
    return top.join(used, "site", "left").where(c("rank") <= max_pages - F.coalesce("_used", F.lit(0))).drop("_used")


def crawl_depth(edges: DataFrame, seeds: DataFrame, max_pages: int | None = 100,
                checkpoint_every: int = 3) -> DataFrame:
    """Breadth-first depth of each URL from its site's seed: ``site, url, depth``.

    At most ``max_pages`` URLs per site (None: all), level by level, content before sitemaps.  One round is an
    equality join of the newest level with the edges and an anti join with what is known.  Levels and the known
    set are cut with reliable checkpoints, so that lost executors cost one round.  Rounds go on until a level is
    empty.  Edges are dealt by their source once and stay dealt, so that a round shuffles the level and not the edges.
    """
    checkpoint_ready(edges.sparkSession)
    links = edges.where("internal").select(
        "site", U.strip_fragment("src_url").alias("url"), "dst_url").distinct().checkpoint().repartition(
        "site", "url").persist(StorageLevel.DISK_ONLY)
    known = seeds.select("site", U.strip_fragment("url").alias("url")).distinct().select(
        "site", "url", F.lit(0).cast("bigint").alias("depth")).checkpoint()
    level, depth = known, 0
    while True:
        depth += 1
        reached = links.join(level.select("site", "url"), ["site", "url"]).select(
            "site", c("dst_url").alias("url")).distinct()
        fresh = reached.join(known.select("site", "url"), ["site", "url"], "left_anti").checkpoint()
        level = fresh if max_pages is None else _within_budget(fresh, known, max_pages).checkpoint()
        level = level.select("site", "url", F.lit(depth).cast("bigint").alias("depth"))
        if level.isEmpty():
            break
        known = known.unionByName(level)
        if depth % checkpoint_every == 0:
            known = known.checkpoint()
    links.unpersist()
    return known


def _within_budget(fresh: DataFrame, known: DataFrame, max_pages: int) -> DataFrame:
    """New URLs that fit into the open budget of their site; only sites that exceed it are ranked."""
    used = known.groupBy("site").agg(F.count(F.lit(1)).alias("_used"))
    new = fresh.groupBy("site").agg(F.count(F.lit(1)).alias("_new"))
    room = new.join(used, "site").select("site", (F.lit(max_pages) - c("_used")).alias("_room"), "_new")
    placed = salted_lookup(fresh, room, ["site"], "url", "inner")
    whole = placed.where(c("_new") <= c("_room"))
    cut = first_k(placed.where(c("_new") > c("_room")), ["site"], [_sitemap_last(), "url"], max_pages, "url", "_n")
    return whole.select("site", "url").unionByName(cut.where(c("_n") <= c("_room")).select("site", "url"))


def broken_links(edges: DataFrame, url_status: DataFrame) -> DataFrame:
    """Distinct internal links per site whose target answered 400 or worse: ``site, dst_url, status``.

    Edges are reduced to distinct (site, target) before the join, so a page every other page links to is one row.
    """
    bad = url_status.where(c("status") >= 400).groupBy(c("url").alias("dst_url")).agg(
        F.max("status").alias("status"))
    targets = edges.where("internal").select("site", "dst_url").distinct()
    return targets.join(bad, "dst_url").select("site", "dst_url", "status")


def page_broken_links(edges: DataFrame, url_status: DataFrame) -> DataFrame:
    """Broken internal links per page: ``src_page_id, n_broken``."""
    bad = url_status.where(c("status") >= 400).select(c("url").alias("dst_url")).distinct()
    hits = edges.where("internal").select("src_page_id", "dst_url").join(bad, "dst_url")
    return hits.groupBy("src_page_id").agg(F.count_distinct("dst_url").alias("n_broken"))


def technical_only_sites(signals: DataFrame) -> DataFrame:
    """Sites without one content page, with the root page to fetch for them."""
    flagged = signals.select("site", "url", U.is_technical_strict("url").alias("t"))
    return flagged.groupBy("site").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(~c("t")).alias("content_pages"),
        F.min(F.concat(rx("url", r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)"), F.lit("/"))).alias("root_url"),
    ).where(c("content_pages") == 0)


# --- CMS pages -----------------------------------------------------------------------------------
def cms_match(suggestions: DataFrame, cms_pages: DataFrame) -> DataFrame:
    """First CMS page per suggestion whose link equals the URL or whose slug the URL ends with.

    The suffix test is an equality on the last path segment: a slug has no slash, so a URL that ends with it ends
    with a segment that ends with it.  CMS pages are reduced to the first one per link and per slug before the joins,
    so that many pages with one slug never pair with many URLs; a frequent slug is one row on the right, and
    adaptive execution splits its left side.
    """
    first = F.min("cms_id").alias("cms_id")
    by = {n: cms_pages.where(c(n) != "").groupBy(n).agg(first) for n in ("link", "slug")}
    urls = suggestions.select("url").distinct()
    by_link = urls.join(by["link"].withColumnRenamed("link", "url"), "url").select("url", "cms_id")
    seg = rx(c("url"), r"([^/]*)$")
    n = F.length(seg)
    # all suffixes of the last segment: linear in its length, and each is an exact key
    ends = urls.select("url", F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(seg, i, n)))).alias("slug"))
    by_slug = ends.where(c("slug") != "").join(by["slug"], "slug").select("url", "cms_id")
    return by_link.unionByName(by_slug).groupBy("url").agg(first)


def faq_html(faq: Column) -> Column:
    """``ARRAY<STRUCT<q,a>>`` → HTML section."""
    items = F.transform(faq, lambda f: F.concat(
        F.lit('<div class="faq-item"><h3>'), f["q"], F.lit("</h3><p>"), f["a"], F.lit("</p></div>")))
    return F.concat(F.lit('<div class="faq-section"><h2>Frequently Asked Questions</h2>'), F.array_join(items, ""),
                    F.lit("</div>"))


def cms_payload(matched: DataFrame) -> DataFrame:
    """``url, cms_id, new_title, new_meta, new_h1, faq, content`` → update payload columns."""
    with_h1 = F.when(F.coalesce("new_h1", F.lit("")) != "",
                     F.concat(F.lit("<h1>"), c("new_h1"), F.lit("</h1>\n"), F.coalesce("content", F.lit("")))
                     ).otherwise(F.coalesce("content", F.lit("")))
    has_faq = F.size("faq") > 0
    body = F.when(has_faq, F.concat(with_h1, F.lit("\n"), faq_html(c("faq")))).otherwise(with_h1)
    changed = (F.coalesce("new_h1", F.lit("")) != "") | has_faq
    return matched.select(
        "url", "cms_id", F.nullif("new_title", F.lit("")).alias("title"),
        F.nullif("new_meta", F.lit("")).alias("meta_description"), F.when(changed, body).alias("content"))
