"""Composite jobs as a whole, sinks with their read-back, and the rules that only these reach."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelens.functions import fixed_values as fv
from pagelens.functions import urls as U
from pagelens.operators import checks as C
from pagelens.operators import recommend as R
from pagelens.operators import site as A
from pagelens.operators import visibility as V
from pagelens.plans import jobs as JB
from pagelens.session import checkpoint_ready
from pagelens.sources import io
from pagelens.streaming import stream as ST

from . import sqlkit as K
from .answers import ANS, EVAL, SUG, SESS, _drain, event_stream, profile, sessions
from .inputs import answers, table
from .pages import W
from .registry import ORACLE, query
from .scores import PROWS, host_signals

c = F.col


def _sub(name: str) -> str:
    return f"({ORACLE[name]})"


# --- jobs -------------------------------------------------------------------------------------------
@query("audit_aeo_geo", f"""SELECT s.*, p.platform, p.hits, r.kind, r.advice FROM {_sub('site_mean_scores')} s JOIN {_sub('platform_site')} p ON p.site = s.site
  LEFT JOIN {_sub('site_recommendations')} r ON r.site = s.site""")
def audit_aeo_geo(spark, d):
    out = JB.audit_aeo_geo(host_signals(spark, d))
    return out["scores"].join(out["platform"], "site").join(out["recommendations"], "site", "left")


@query("audit_page", f"""SELECT p.*, r.category, r.priority, r.title, r.action FROM {_sub('page_breakdown')} p
  LEFT JOIN {_sub('page_recommendations')} r ON r.page_id = p.page_id""")
def audit_page(spark, d):
    out = JB.audit_page(host_signals(spark, d))
    return out["pages"].join(out["recommendations"].select("page_id", "category", "priority", "title", "action"), "page_id", "left")


TOP10 = "topten AS (SELECT * FROM sig QUALIFY row_number() OVER (PARTITION BY host ORDER BY word_count DESC, page_id) <= 10)"


@query("optimize_sites", f"{W}, {TOP10}, {SUG.replace('FROM sig', 'FROM topten')} SELECT page_id, site, brand, language, new_title, new_meta, new_h1 FROM sug")
def optimize_sites(spark, d):
    return JB.optimize_sites(host_signals(spark, d)).select("page_id", "site", "brand", "language", "new_title", "new_meta", "new_h1")


CHOSEN = f"""{ANS.replace('ans AS', 'every AS', 1)}, ch AS (SELECT site, query_id, row_number() OVER (PARTITION BY site ORDER BY query_id) AS k FROM every),
  few AS (SELECT * FROM ch WHERE k <= 4 + CAST(substr(site, 2) AS INT)), fits AS (SELECT site FROM few GROUP BY site HAVING count(*) <= 8),
  ans AS (SELECT every.* FROM every JOIN few ON few.site = every.site AND few.query_id = every.query_id JOIN fits ON fits.site = every.site)"""


@query("query_visibility", f"""SELECT s.*, t.name AS top_name, t.mentions AS top_mentions FROM ({ORACLE['visibility_summary'].replace(ANS, CHOSEN)}) s
  LEFT JOIN (SELECT * FROM ({ORACLE['top_competitors'].replace(ANS, CHOSEN)}) WHERE rank = 1) t ON t.site = s.site""")
def query_visibility(spark, d):
    """Sites choose 4 to 10 of their queries; those with more than 8 are refused and have no summary."""
    a = answers(spark, d)
    asked = a.select("site", "query_id", "category", F.lit("").alias("text"))
    k = F.row_number().over(Window.partitionBy("site").orderBy("query_id"))
    chosen = asked.withColumn("k", k).where(c("k") <= 4 + F.substring("site", 2, 1).cast("int"))
    out = JB.query_visibility(asked, a.select("site", "query_id", "brand", "response"), chosen)
    first = out["top_competitors"].where("rank = 1").select("site", c("name").alias("top_name"), c("mentions").alias("top_mentions"))
    return out["summary"].join(first, "site", "left")


@query("recommend_keywords", f"SELECT * FROM {_sub('aeo_keywords')} UNION ALL SELECT * FROM {_sub('geo_keywords')}")
def recommend_keywords(spark, d):
    return JB.recommend_keywords(profile(spark, d))


@query("brand_page_visibility", f"""SELECT page_id, site, brand, visibility, 'query' AS kind, query AS text FROM {_sub('page_visibility')}
  UNION ALL SELECT page_id, site, brand, visibility, 'advice', advice FROM {_sub('visibility_advice')}""")
def brand_page_visibility(spark, d):
    s = host_signals(spark, d)
    out = JB.brand_page_visibility(s, A.brand_name(s))
    rows = [df.select("page_id", "site", "brand", "visibility", F.lit(kind).alias("kind"), c(text).alias("text"))
            for df, kind, text in ((out["queries"], "query", "query"), (out["advice"], "advice", "advice"))]
    return rows[0].unionByName(rows[1])


# --- sinks and read-back ----------------------------------------------------------------------------
def _folder(spark) -> str:
    checkpoint_ready(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"


def _audited_twice(spark, d) -> str:
    """The folder of an audit that ran twice as one run; the second time replaces what the first wrote.

    Pages are extracted once, as the library asks for; both audits take the stored signals.
    """
    root = _folder(spark)
    io.write_table(host_signals(spark, d), f"{root}/extracted", "overwrite")
    extracted = spark.read.parquet(f"{root}/extracted")
    for _ in range(2):
        JB.audit_sites(extracted, root, "first")
    return root


@query("stored_audit_signals", _sub("site_signals")[1:-1])
def stored_audit_signals(spark, d):
    return io.read_run(spark, f"{_audited_twice(spark, d)}/audits", "first").select("site", "kind", "value")


@query("stored_audit_sites", f"SELECT p.*, n.stored_pages FROM {_sub('site_profile')} p JOIN (SELECT {K.host('url')} AS site, count(*) AS stored_pages FROM pages GROUP BY 1) n ON n.site = p.site")
def stored_audit_sites(spark, d):
    root = _audited_twice(spark, d)
    n = io.read_run(spark, f"{root}/pages", "first").groupBy("site").agg(F.count(F.lit(1)).alias("stored_pages"))
    return io.read_run(spark, f"{root}/sites").drop("run", "site_bucket").join(n, "site")


@query("stored_scores", f"SELECT 'a' AS run, x.* FROM {_sub('pillar_scores')} x UNION ALL SELECT 'b', x.* FROM {_sub('pillar_scores')} x")
def stored_scores(spark, d):
    """Two runs side by side, the second written twice."""
    root, scores = _folder(spark), A.pillar_scores(host_signals(spark, d))
    for run in ("a", "b", "b"):
        io.write_scores(scores, root, run)
    return io.read_run(spark, f"{root}/scores")


@query("stored_optimizations", _sub("title_suggestions")[1:-1])
def stored_optimizations(spark, d):
    root, s = _folder(spark), host_signals(spark, d)
    io.write_optimizations(R.title_suggestions(R.page_suggestions(s, A.brand_guess(s))), root, "a")
    return io.read_run(spark, f"{root}/optimizations", "a").drop("run")


@query("stored_answers", f"WITH {ANS}, {EVAL} SELECT site, query_id, strength, is_mentioned, recommendation FROM ev")
def stored_answers(spark, d):
    root = _folder(spark)
    io.write_answers(V.evaluate_answers(answers(spark, d)), root, "a")
    return io.read_run(spark, f"{root}/query_visibility_results", "a").select("site", "query_id", "strength", "is_mentioned", "recommendation")


@query("scores_as_json", _sub("pillar_scores")[1:-1])
def scores_as_json(spark, d):
    root, scores = _folder(spark), A.pillar_scores(host_signals(spark, d))
    io.write_json(scores, root)
    return spark.read.schema(scores.schema).json(root)


@query("stored_pages", "SELECT page_id, url, sha1(html) AS content_hash FROM pages")
def stored_pages(spark, d):
    return io.read_pages(spark, f"{d}/pages.parquet").select("page_id", "url", F.sha1(c("html").cast("binary")).alias("content_hash"))


# --- rules ------------------------------------------------------------------------------------------
@query("brands_from_urls", f"""SELECT page_id, concat(upper(substr(l, 1, 1)), lower(substr(l, 2))) AS brand
  FROM (SELECT page_id, string_split({K.host('url')}, '.')[1] AS l FROM pages)""")
def brands_from_urls(spark, d):
    return table(spark, d, "pages").select("page_id", U.brand_from_url("url").alias("brand"))


@query("task_top_search_answer", f"""{PROWS}, n AS (SELECT site, pillar, task, count(*) AS pages FROM ck WHERE task IS NOT NULL AND pillar IN ('SEO', 'AEO') GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY site, pillar ORDER BY pages DESC, task) AS rank FROM n QUALIFY rank <= 25) SELECT site, pillar, task, pages, rank, concat(task, ' (x', pages, ')') AS label FROM r""")
def task_top_search_answer(spark, d):
    rows = C.check_rows(host_signals(spark, d), "pillars").where(c("pillar").isin("SEO", "AEO"))
    return A.task_counts(rows, fv.MAX_TOP_TASKS)


REPLY = """CASE conv_id % 4 WHEN 0 THEN concat('["Who sells lamps ', conv_id, '?", "b", "c", "d", "e"]') WHEN 1 THEN '[broken "list"]'
  WHEN 2 THEN concat('["only one ', conv_id, '"]') ELSE concat('# Queries', chr(10), '- not this one, as it is a point', chr(10), ' "What is it, ', conv_id, '?" ', chr(10), 'short', chr(10), text) END"""


@query("generated_queries", f"""WITH r AS (SELECT conv_id, turn, trim({REPLY}, ' ' || chr(9) || chr(10) || chr(13)) AS s FROM conversations), b AS (SELECT *, starts_with(s, '[') AND ends_with(s, ']') AS listed FROM r),
  p AS (SELECT *, CASE WHEN listed AND json_valid(s) THEN from_json(s, '["VARCHAR"]') END AS parsed, list_transform(string_split(s, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))) AS ls FROM b),
  q AS (SELECT *, list_filter(list_transform(list_filter(ls, lambda x: NOT starts_with(x, '#') AND NOT starts_with(x, '-')), lambda x: trim(replace(replace(x, '"', ''), '''', ''), ' ' || chr(9) || chr(13))), lambda x: length(x) > 10)[1:5] AS lines FROM p)
  SELECT conv_id, turn, len(CASE WHEN listed AND parsed IS NULL THEN [] WHEN len(parsed) = 5 THEN parsed ELSE lines END) AS n, array_to_string(CASE WHEN listed AND parsed IS NULL THEN [] WHEN len(parsed) = 5 THEN parsed ELSE lines END, '|') AS queries FROM q""")
def generated_queries(spark, d):
    r = table(spark, d, "conversations").select("conv_id", "turn", F.expr(REPLY).alias("raw"))
    return io.generated_queries(r).select("conv_id", "turn", F.size("queries").alias("n"), F.array_join("queries", "|").alias("queries"))


# --- sessions with a timer --------------------------------------------------------------------------
@query("stream_abandoned", f"WITH {SESS} SELECT id, site_id, current_step, created_at, created_at + INTERVAL 24 HOUR AS abandoned_at FROM sess WHERE status = 'started'")
def stream_abandoned(spark, d):
    """Sessions the stream's timers ended, and those whose time is not up when the stored events end, in batch form."""
    e = event_stream(spark, d)
    e = e.select(F.concat("user_id", F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("id"), (c("user_id") % 10).cast("string").alias("site_id"),
                 c("event_type").alias("step"), "event_id", "ts")
    key, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key)
    spark.conf.set(key, store)
    try:
        ended, watermark = _drain(spark, ST.stream_abandoned(e))
    finally:
        spark.conf.set(key, before)
    at = c("created_at").cast("timestamp") + F.expr("INTERVAL 24 HOURS")
    started = sessions(spark, d).where("status = 'started'").select("id", "site_id", "current_step", c("created_at").cast("timestamp").alias("created_at"), at.alias("abandoned_at"))
    rows = ended.select(started.columns).unionByName(ST.still_open(started, "abandoned_at", watermark))
    ntz = {n: c(n).cast("timestamp_ntz") for n in ("created_at", "abandoned_at")}
    return rows.withColumns(ntz)
