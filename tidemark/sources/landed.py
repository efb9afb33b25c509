"""Landed API payloads and web pages -> flat raw observations.

Payload frames carry one document per row (``payload`` string); ``read_payloads``
loads such files from a folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions.numeric import exact_text, lookup
from tidemark.operators import keyed


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One row per landed JSON file; the file name tells the request."""
    return spark.read.text(path, wholetext=True).select(
        F.col("value").alias("payload"), F.col("_metadata.file_name").alias("file_name")
    )


def _multiplier(family: str, indicator: Column) -> Column:
    table = {i: m for (s, i), m in K.SOURCE_MULTIPLIERS.items() if s == family}
    return F.coalesce(lookup(indicator, table), F.lit(1.0))


def _unit(indicator: Column) -> Column:
    return lookup(indicator, {code: meta[2] for code, meta in K.INDICATORS.items()})


_FLAT = ["indicator_code", "country_code", "period", "raw_value", "raw_unit", "raw_json"]


def _flat(df: DataFrame, family: str, value: Column) -> DataFrame:
    scaled = value * _multiplier(family, F.col("indicator_code"))
    return df.withColumns({"raw_value": exact_text(scaled), "raw_unit": _unit(F.col("indicator_code"))}).select(*_FLAT)


def paged_observations(payloads: DataFrame) -> DataFrame:
    """``[meta, [{date, value}, ...]]`` per indicator and country; empty dates and null values dropped.

    ``payloads``: indicator_code, country_code, payload.
    """
    entries = F.from_json(F.get_json_object("payload", "$[1]"), "array<struct<date:string,value:double>>")
    rows = payloads.select("indicator_code", "country_code", F.inline(entries)).filter(
        F.col("value").isNotNull() & (F.coalesce(F.col("date"), F.lit("")) != "")
    )
    rows = rows.withColumn("period", F.col("date")).withColumn("raw_json", F.to_json(F.struct("date", "value")))
    return _flat(rows, "WORLD_BANK", F.col("value"))


def nested_map_observations(payloads: DataFrame, countries: DataFrame, code_map: dict[str, str], year_from: int) -> DataFrame:
    """``values[code][country][year] -> value``: tracked countries and years from ``year_from`` on.

    ``countries``: country_code of the tracked countries (a small fixed list); ``code_map``:
    source code -> indicator.
    """
    parsed = F.from_json("payload", "values map<string,map<string,map<string,double>>>")["values"]
    rows = (
        payloads.select(F.explode(parsed).alias("_code", "_countries"))
        .select("_code", F.explode("_countries").alias("country_code", "_years"))
        .join(F.broadcast(countries.select("country_code")), "country_code", "left_semi")
        .select("_code", "country_code", F.explode("_years").alias("period", "value"))
        .filter(F.col("value").isNotNull() & (F.col("period").try_cast("int") >= year_from))
        .withColumn("indicator_code", lookup(F.col("_code"), code_map))
        .withColumn("raw_json", F.to_json(F.struct("country_code", "period", "value")))
    )
    return _flat(rows, "IMF", F.col("value"))


def observation_list(payloads: DataFrame, country: str = "USA") -> DataFrame:
    """``observations: [{date, value}]`` with text values; ``.`` and empty mean missing.

    ``payloads``: indicator_code, payload.
    """
    entries = F.from_json("payload", "observations array<struct<date:string,value:string>>")["observations"]
    rows = payloads.select("indicator_code", F.inline(entries)).filter(
        ~F.coalesce(F.col("value"), F.lit(".")).isin(".", "")
    ).withColumns({
        "country_code": F.lit(country), "period": F.substring("date", 1, 4),
        "raw_json": F.to_json(F.struct("date", "value")),
    })
    factor = _multiplier("FRED", F.col("indicator_code"))
    scaled = F.when(factor == 1.0, F.col("value")).otherwise(exact_text(F.col("value").try_cast("double") * factor))
    return rows.withColumns({"raw_value": scaled, "raw_unit": _unit(F.col("indicator_code"))}).select(*_FLAT)


def source_union(parts: dict[str, DataFrame]) -> DataFrame:
    """All sources as one raw frame."""
    out = None
    for code, part in parts.items():
        tagged = part.withColumn("source_code", F.lit(code))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def extracted_records(payloads: DataFrame, key: str) -> DataFrame:
    """Model output: first list inside the object (or the list itself), unsure rows dropped.

    A row counts when its confidence, 1 when absent, is at least the minimum.
    """
    record = "array<struct<indicator_code:string,country_code:string,period:string,value:double,confidence:double>>"
    members = F.map_values(F.from_json("payload", "map<string,string>"))
    first_list = F.try_element_at(F.filter(members, lambda m: F.ltrim(m).startswith("[")), F.lit(1))
    body = F.when(F.ltrim("payload").startswith("["), F.col("payload")).otherwise(first_list)
    sure = F.filter(
        F.from_json(body, record), lambda r: F.coalesce(r["confidence"], F.lit(1.0)) >= K.EXTRACTION_MIN_CONFIDENCE
    )
    return payloads.select(key, F.inline(sure))


# --- Web pages --------------------------------------------------------------

def page_text(html: Column) -> Column:
    """Visible text: script and style blocks and tags removed, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(html, K.SCRIPT_BLOCK, " "), K.TAG, " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def page_links(pages: DataFrame, url_patterns: list[str] | None = None) -> DataFrame:
    """Article links per page: wanted urls with a real title, first of each url, first 25 of a page."""
    found = F.arrays_zip(
        F.regexp_extract_all("html", F.lit(K.ANCHOR), F.lit(1)).alias("href"),
        F.regexp_extract_all("html", F.lit(K.ANCHOR), F.lit(2)).alias("body"),
    )
    base = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    links = pages.select("page_id", base.alias("_base"), F.posexplode(found).alias("pos", "a"))
    href = F.col("a.href")
    title = F.trim(F.regexp_replace(F.regexp_replace(F.col("a.body"), K.TAG, ""), r"\s+", " "))
    links = links.select(
        "page_id", "pos", F.when(href.startswith("http"), href).otherwise(F.concat("_base", href)).alias("url"),
        title.alias("title"),
    ).filter(F.length("title") >= K.LINK_TITLE_MIN)
    wanted = F.lit(False)
    for pattern in url_patterns or K.ARTICLE_URLS:
        wanted = wanted | F.col("url").rlike(pattern)
    first = keyed.earliest(links.filter(wanted), ["page_id", "url"], [F.col("pos")], ["pos", "title"])
    top = keyed.top_per_key(first, ["page_id"], [F.col("pos")], K.LINKS_PER_PAGE)
    return top.select("page_id", "rank", "url", F.substring("title", 1, K.LINK_TITLE_MAX).alias("title"))
