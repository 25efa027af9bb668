"""Answers of remote services, stored as JSON or mark-up, read as rows. Broken payloads give no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.measure import parse_price

SHOPPING = "items array<struct<title:string,price:string,source:string,link:string>>"
ELEMENTS = "elements array<struct<id:bigint,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>>"
PLACES = "places array<struct<name:string,lat:string,lon:string,address:struct<city:string,town:string,village:string,country:string>>>"
LINK = "<a [^>]*href=\"([^\"]*)\"[^>]*>([^<]*)</a>"


def _exploded(payloads: DataFrame, schema: str, field: str, most: int | None = None) -> DataFrame:
    rows = F.from_json("payload", schema)[field]
    return payloads.select("id", F.posexplode(F.slice(rows, 1, most) if most else rows).alias("ord", "r"))


def shopping_rows(payloads: DataFrame, most: int = 6) -> DataFrame:
    """id, ord, title, price, currency, source, link of payloads (id, payload): the first rows of each answer."""
    return _exploded(payloads, SHOPPING, "items", most).withColumn("p", parse_price(F.col("r.price"))).select("id", "ord", "r.title", "p.price", "p.currency", "r.source", "r.link")


def map_elements(payloads: DataFrame, default: str = "Store") -> DataFrame:
    """id, element, name, lat, lon: an element's own position, else its centre, else it goes."""
    rows = _exploded(payloads, ELEMENTS, "elements")
    lat, lon = F.coalesce("r.lat", "r.center.lat"), F.coalesce("r.lon", "r.center.lon")
    name = F.coalesce(F.nullif(F.try_element_at("r.tags", F.lit("name")), F.lit("")), F.lit(default))
    return rows.select("id", F.col("r.id").alias("element"), name.alias("name"), lat.alias("lat"), lon.alias("lon")).where("lat is not null and lon is not null")


def geocoded(payloads: DataFrame) -> DataFrame:
    """id, ord, city, country, lat, lon: the first known of city, town, village and name; without it or a country a place goes."""
    known = [F.nullif(F.col(c), F.lit("")) for c in ("r.address.city", "r.address.town", "r.address.village", "r.name")]
    rows = _exploded(payloads, PLACES, "places")
    out = rows.select("id", "ord", F.coalesce(*known).alias("city"), F.nullif(F.col("r.address.country"), F.lit("")).alias("country"), F.col("r.lat").try_cast("double").alias("lat"), F.col("r.lon").try_cast("double").alias("lon"))
    return out.where("city is not null and country is not null")


def result_links(pages: DataFrame, most: int = 12) -> DataFrame:
    """page_id, ord, href, title: the first links of each page (page_id, html)."""
    pairs = F.arrays_zip(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(LINK), F.lit(2)).alias("title"))
    return pages.select("page_id", F.posexplode(F.slice(pairs, 1, most)).alias("ord", "r")).select("page_id", "ord", "r.href", "r.title")
