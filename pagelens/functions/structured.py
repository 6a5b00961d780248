"""JSON-LD blocks as JSON strings, read with the built-in JSON path functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import as_col
from .html import JSONLD, rx_all

FAQ_SCHEMA = "struct<mainEntity:array<struct<name:string,acceptedAnswer:struct<text:string>>>>"


def jsonld_blocks(html_nc) -> Column:
    """Valid JSON-LD bodies; a top-level array gives one entry per element."""
    raw = F.transform(rx_all(html_nc, JSONLD, 1), lambda b: F.trim(b))
    valid = F.filter(raw, lambda b: F.try_parse_json(b).isNotNull())
    each = F.transform(
        valid,
        lambda b: F.when(F.startswith(b, F.lit("[")), F.from_json(b, "array<string>")).otherwise(F.array(b)),
    )
    return F.flatten(each)


def json_type(b) -> Column:
    return F.get_json_object(as_col(b), "$.@type")


def json_types(blocks) -> Column:
    """``@type`` of every block that has one."""
    return F.filter(F.transform(as_col(blocks), json_type), lambda t: t.isNotNull() & (t != ""))


def blocks_of_type(blocks, name: str) -> Column:
    return F.filter(as_col(blocks), lambda b: json_type(b) == name)


def last_value(blocks, path: str) -> Column:
    """Value of the last block that has the path; '' when none has."""
    found = F.filter(F.transform(as_col(blocks), lambda b: F.get_json_object(b, path)), lambda v: v.isNotNull())
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))


def first_value(blocks, path: str) -> Column:
    found = F.filter(F.transform(as_col(blocks), lambda b: F.get_json_object(b, path)), lambda v: v.isNotNull())
    return F.coalesce(F.get(found, F.lit(0)), F.lit(""))


def faq_entities(blocks) -> Column:
    """ARRAY<STRUCT<question,answer>> of all FAQPage entities."""
    per_block = F.transform(
        blocks_of_type(blocks, "FAQPage"),
        lambda b: F.transform(
            F.coalesce(F.from_json(b, FAQ_SCHEMA)["mainEntity"],
                       F.array().cast("array<struct<name:string,acceptedAnswer:struct<text:string>>>")),
            lambda e: F.struct(
                F.coalesce(e["name"], F.lit("")).alias("question"),
                F.coalesce(e["acceptedAnswer"]["text"], F.lit("")).alias("answer"),
            ),
        ),
    )
    return F.flatten(per_block)
