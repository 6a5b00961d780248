"""Sources and sinks: stored crawl results in, result tables out."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import urls as U
from ..functions.exprs import entries, rx, rx_sub

c = F.col


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet", partitions: int | None = None) -> DataFrame:
    """Crawled pages; alternative column names are settled once here.  ``partitions`` deals the rows out anew."""
    df = spark.read.format(fmt).load(path)
    df = df.repartition(partitions) if partitions else df
    html = [c(n) for n in ("html", "body", "content") if n in df.columns]
    rest = [n for n in df.columns if n not in ("page_id", "url", "html", "body", "content")]
    return df.select("page_id", "url", F.coalesce(*html).alias("html"), *rest)


# --- sitemaps and robots -------------------------------------------------------------------------
def sitemap_urls(sitemaps: DataFrame) -> DataFrame:
    """``host, path, body`` of stored sitemaps → distinct same-site URLs.

    XML bodies give their ``<loc>`` values, text bodies one URL per line.  Per host the preferred XML file with
    content counts: ``/sitemap.xml`` before ``/sitemap_index.xml``; text files are added.
    """
    txt = F.endswith(F.lower("path"), F.lit(".txt"))
    locs = F.regexp_extract_all("body", F.lit(r"(?is)<(?:[a-z0-9]+:)?loc>\s*(.*?)\s*</(?:[a-z0-9]+:)?loc>"), F.lit(1))
    found = sitemaps.select(
        "host", "path", F.when(txt, F.split("body", r"\r?\n")).otherwise(locs).alias("locs"),
        F.when(txt, 0).when(c("path") == "/sitemap.xml", 1).otherwise(2).alias("pref"))
    w = Window.partitionBy("host", c("pref") > 0).orderBy("pref", "path")
    best = found.where(F.size("locs") > 0).withColumn("rank", F.row_number().over(w)).where(
        (c("pref") == 0) | (c("rank") == 1))
    root = F.concat(F.lit("https://"), c("host"), F.lit("/"))
    urls = best.select("host", F.explode(entries("locs")).alias("loc")).where(F.trim("loc") != "").select(
        "host", U.strip_fragment(U.resolve_url(root, F.replace(c("loc"), F.lit("&amp;"), F.lit("&")))).alias("url"))
    return urls.where(U.site_of("url") == U.registrable_domain("host")).distinct()


def robots_rules(robots: DataFrame) -> DataFrame:
    """``host, raw`` → ``host, line, kind, value``; comments and other directives are left out."""
    lines = robots.select("host", F.posexplode(F.split("raw", r"\r?\n")).alias("line", "_t")).select(
        "host", "line", F.trim("_t").alias("_t")).where(~F.startswith("_t", F.lit("#")))
    kind = F.lower(rx("_t", r"(?i)^(disallow|sitemap):"))
    return lines.select("host", "line", kind.alias("kind"), F.trim(rx_sub("_t", r"^[^:]*:")).alias("value")).where(
        c("kind") != "")


def ai_crawler_access(robots: DataFrame) -> DataFrame:
    """Does the file let AI crawlers in: not when the block of one of them has ``Disallow: /``.

    Blocks are folded inside the row: one pass over the lines carries the agents of the open block.
    """
    from ..functions import fixed_values as fv

    lines = F.filter(F.transform(F.split(F.lower("raw"), r"\r?\n"), lambda s: F.trim(s)),
                     lambda s: (s != "") & ~F.startswith(s, F.lit("#")))
    start = F.struct(F.lit("").alias("agents"), F.lit(False).alias("in_rules"), F.lit(False).alias("barred"))
    named = "|".join(fv.AI_CRAWLERS)

    def step(st: Column, ln: Column) -> Column:
        is_agent = F.startswith(ln, F.lit("user-agent:"))
        agents = F.when(is_agent & st["in_rules"], ln).when(is_agent, F.concat(st["agents"], F.lit(" "), ln)).otherwise(
            st["agents"])
        bars = ln.rlike(r"^disallow:\s*/\s*$") & st["agents"].rlike(named)
        return F.struct(agents.alias("agents"), (~is_agent).alias("in_rules"), (st["barred"] | bars).alias("barred"))

    return robots.select("host", (~F.aggregate(lines, start, step)["barred"]).alias("ai_allowed"))


# --- stored model replies ------------------------------------------------------------------------
def clean_reply(raw: Column) -> Column:
    """Code fences and a language hint removed."""
    s = F.trim(rx_sub(raw, r"^\s+|\s+$"))
    return F.when(F.startswith(s, F.lit("```")), F.trim(rx_sub(rx_sub(s, r"^`+[A-Za-z]*\s*"), r"\s*`+$"))).otherwise(s)


def parse_reply(raw: Column, fallback: Column | None = None) -> Column:
    """Valid JSON text of a reply: as it is, else from the first ``{`` to the last ``}``, else so for ``[`` and ``]``,
    else the fallback."""
    s = clean_reply(raw)
    cut, listed = rx(s, r"(?s)(\{.*\})"), rx(s, r"(?s)(\[.*\])")
    ok = lambda x: F.when(F.try_parse_json(x).isNotNull() & (x != ""), x)
    return F.coalesce(ok(s), ok(cut), ok(listed), F.lit(None).cast("string") if fallback is None else fallback)


def ingest_replies(replies: DataFrame, schema: str, raw: str = "raw", length: int | None = None) -> DataFrame:
    """Typed column ``parsed``; ``valid`` is false for broken replies and for lists of another length."""
    json = replies.withColumn("json", parse_reply(c(raw)))
    parsed = json.withColumn("parsed", F.from_json("json", schema, {"mode": "PERMISSIVE"}))
    ok = c("parsed").isNotNull()
    if length is not None:
        ok = ok & (F.size("parsed") == length)
    return parsed.withColumn("valid", F.coalesce(ok, F.lit(False)))


def generated_queries(replies: DataFrame, raw: str = "raw", wanted: int = 5) -> DataFrame:
    """``queries`` that a model's reply names: a JSON list of the wanted length as it is, else the reply's lines.

    Lines lose quotation marks; headings (``#``), list points (``-``) and lines of ten characters or fewer do not count, and the
    first ``wanted`` stay.  The list is empty for a null reply, for broken JSON in brackets and where no line counts: take
    ``recommend.default_queries`` there.
    """
    s = F.trim(F.coalesce(c(raw), F.lit("")), F.lit(" \t\n\r"))
    none = F.array().cast("array<string>")
    listed = s.startswith("[") & s.endswith("]")
    parsed = F.from_json(F.when(listed & F.try_parse_json(s).isNotNull(), s), "array<string>")
    lines = F.transform(F.split(s, "\n"), lambda x: F.trim(x, F.lit(" \t\r")))
    lines = F.filter(lines, lambda x: ~x.startswith("#") & ~x.startswith("-"))
    lines = F.transform(lines, lambda x: F.trim(F.translate(x, "\"'", ""), F.lit(" \t\r")))
    lines = F.slice(F.filter(lines, lambda x: F.length(x) > 10), 1, wanted)
    return replies.withColumn("queries", F.when(listed & parsed.isNull(), none).when(F.size(parsed) == wanted, parsed).otherwise(lines))


# --- sinks ---------------------------------------------------------------------------------------
def write_table(df: DataFrame, path: str, mode: str = "append", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_run(df: DataFrame, path: str, run: str, partition_by: list[str] | None = None) -> None:
    """Rows of one run below ``path/run=<run>``.  A repeated run replaces all that it wrote before and nothing else, so a job
    that was ended half-way, or started twice, leaves the same table."""
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", run):
        raise ValueError(f"a run is named by letters, digits and _.-: {run!r}")
    write_table(df, f"{path}/run={run}", "overwrite", partition_by)


def read_run(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """Rows of a table of runs (of one run, if named), with their ``run``; files of other runs are not read."""
    rows = spark.read.parquet(path)
    rows = rows.withColumn("run", c("run").cast("string"))
    return rows if run is None else rows.where(c("run") == run)


def with_site_bucket(df: DataFrame, buckets: int = 256) -> DataFrame:
    """Bounded partition column for tables keyed by site (one folder per site would not be bounded)."""
    return df.withColumn("site_bucket", F.pmod(F.xxhash64("site"), F.lit(buckets)).cast("int"))


def write_audit(sites: DataFrame, pages: DataFrame, audits: DataFrame, root: str, run: str | None = None) -> None:
    """Sites (known ones are ignored), pages and audits below ``root``, by site bucket; appended, or as a named run.

    With a ``run``, sites of other runs are the known ones, and a repeated run leaves the same tables (``write_run``).
    """
    spark = sites.sparkSession
    try:
        known = spark.read.parquet(f"{root}/sites")
        known = known if run is None else known.where(c("run").cast("string") != run)
        sites = sites.join(known.select("site").distinct(), "site", "left_anti")
    except Exception as err:  # no table yet
        if "PATH_NOT_FOUND" not in str(err):
            raise
    for name, df in (("pages", pages), ("audits", audits), ("sites", sites)):
        # rows of a bucket meet before they are written, or every task would open a file in every bucket; large buckets are split
        _write(with_site_bucket(df).hint("rebalance", "site_bucket"), f"{root}/{name}", run, ["site_bucket"])


def _write(df: DataFrame, path: str, run: str | None, partition_by: list[str] | None = None) -> None:
    if run is None:
        write_table(df, path, partition_by=partition_by)
    else:
        write_run(df, path, run, partition_by)


def write_scores(scores: DataFrame, root: str, run: str | None = None) -> None:
    _write(scores, f"{root}/scores", run)


def write_optimizations(suggestions: DataFrame, root: str, run: str | None = None) -> None:
    _write(suggestions, f"{root}/optimizations", run)


def write_answers(evaluated: DataFrame, root: str, run: str | None = None) -> None:
    _write(evaluated, f"{root}/query_visibility_results", run)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


# --- read back -----------------------------------------------------------------------------------
def latest_audit(audits: DataFrame) -> DataFrame:
    """Newest audit per site: ``max_by`` combines on the map side, so no site's audits are sorted in one task."""
    rest = [n for n in audits.columns if n != "site"]
    return audits.groupBy("site").agg(F.max_by(F.struct(*rest), F.struct("created_at", "audit_id")).alias("a")).select(
        "site", "a.*")


def sample_pages(pages: DataFrame, limit: int = 10) -> DataFrame:
    w = Window.partitionBy("site").orderBy("page_id")
    return pages.withColumn("_n", F.row_number().over(w)).where(c("_n") <= limit).drop("_n")


def list_sites(sites: DataFrame, limit: int = 10) -> DataFrame:
    return sites.orderBy(c("created_at").desc(), "site").limit(limit)


def site_bundle(sites: DataFrame, pages: DataFrame, audits: DataFrame, site: str | None = None,
                limit: int = 10) -> DataFrame:
    """Site with its newest audit and its first pages as a short list (the list is bounded by ``limit``)."""
    if site is not None:
        sites, pages, audits = (d.where(c("site") == site) for d in (sites, pages, audits))
    counts = pages.groupBy("site").agg(F.count(F.lit(1)).alias("pages_count"))
    few = sample_pages(pages.select("site", "page_id", "url", "title"), limit).groupBy("site").agg(
        F.array_sort(F.collect_list(F.struct("page_id", "url", "title"))).alias("pages"))
    newest = latest_audit(audits)
    newest = newest.select("site", F.struct(*[n for n in newest.columns if n != "site"]).alias("audit"))
    return sites.join(counts, "site", "left").join(few, "site", "left").join(newest, "site", "left").withColumn(
        "pages_count", F.coalesce("pages_count", F.lit(0)))
