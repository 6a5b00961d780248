"""Registrable domains by a table of public suffixes, as exact keys.

A rule is a suffix (``co.uk``), a wildcard for one label (``*.ck``) or an exception from one (``!www.ck``); the longest rule
wins, an exception over all, and a host that no rule fits has its last label as suffix.  Each host is cut at its dots, and the
pieces are looked up in the table, so the table may have any size and no pattern is tried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from .links import link_edges
from .skew import salted_lookup

c = F.col


def suffix_rules(lines: DataFrame) -> DataFrame:
    """``rule`` of each line of a suffix list (column ``line``): comments and blank lines left out, lower case, no leading dot."""
    rule = F.regexp_extract(F.lower(F.trim("line")), r"^(?!//)(\S+)", 1)
    return lines.select(F.regexp_replace(rule, r"^(!|\*\.)?\.", "$1").alias("rule")).where("rule != ''").distinct()


def _last(labels: Column, k: Column) -> Column:
    return F.array_join(F.slice(labels, F.size(labels) - k + 1, k), ".")


def registrable_domains(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, suffix, domain`` of each distinct ``host``.

    ``domain`` is the suffix and the label before it.  A host that is a suffix itself has no domain (null); addresses in
    digits or brackets are their own domain and have no suffix.  A dot at the end and upper case do not matter; a null host is
    left out, an empty one has neither.
    """
    known = hosts.select("host").where(c("host").isNotNull()).distinct()
    known = known.withColumn("_l", F.split(F.regexp_replace(F.lower("host"), r"\.$", ""), r"\."))
    number = c("host").rlike(r"^(?:[0-9]+\.){3}[0-9]+$|^\[|:")
    pieces = known.where(~number & (c("host") != "")).select("host", "_l", F.explode(F.sequence(F.lit(1), F.size("_l"))).alias("_k"))
    tried = F.array(F.struct(_last(c("_l"), c("_k")).alias("rule"), c("_k").alias("n"), F.lit(False).alias("sure")),
                    F.struct(F.concat_ws(".", F.lit("*"), F.nullif(_last(c("_l"), c("_k") - 1), F.lit(""))).alias("rule"), c("_k").alias("n"), F.lit(False).alias("sure")),
                    F.struct(F.concat(F.lit("!"), _last(c("_l"), c("_k"))).alias("rule"), (c("_k") - 1).alias("n"), F.lit(True).alias("sure")))
    found = pieces.select("host", F.explode(tried).alias("t")).select("host", "t.*").join(rules.select("rule").distinct(), "rule")
    best = found.groupBy("host").agg(F.max(F.struct("sure", "n")).alias("_best"))
    n = F.coalesce(c("_best.n"), F.lit(1))
    out = known.join(best, "host", "left")
    return out.select(
        "host", F.when(~number & (c("host") != ""), _last(c("_l"), n)).alias("suffix"),
        F.when(number, c("host")).when((c("host") != "") & (F.size("_l") > n), _last(c("_l"), n + 1)).alias("domain"))


def edges_by_domain(signals: DataFrame, rules: DataFrame) -> DataFrame:
    """Link edges with ``site`` and ``internal`` by the table of suffixes: ``site, src_page_id, src_url, dst_url, internal``.

    A host without a domain is a site of its own.
    """
    edges = link_edges(signals).select("src_page_id", "src_url", "dst_url", U.host_of("src_url").alias("src_host"), U.host_of("dst_url").alias("dst_host"))
    hosts = edges.select(F.explode(F.array("src_host", "dst_host")).alias("host")).distinct()
    domains = registrable_domains(hosts, rules).select("host", F.coalesce("domain", "host").alias("site"))
    at = lambda side: domains.select(c("host").alias(f"{side}_host"), c("site").alias(f"{side}_site"))
    placed = salted_lookup(salted_lookup(edges, at("src"), ["src_host"], "dst_url"), at("dst"), ["dst_host"], "src_url")
    return placed.select(c("src_site").alias("site"), "src_page_id", "src_url", "dst_url", (c("src_site") == c("dst_site")).alias("internal"))


def pages_by_domain(signals: DataFrame, rules: DataFrame) -> DataFrame:
    """``signals`` with ``site`` by the table of suffixes."""
    hosts = signals.select("host").distinct()
    domains = registrable_domains(hosts, rules).select("host", F.coalesce("domain", "host").alias("_site"))
    return salted_lookup(signals, domains, ["host"], "page_id").withColumn("site", F.coalesce("_site", "site")).drop("_site").select(signals.columns)
