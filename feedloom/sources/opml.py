"""SRC-04 and SRC-05: OPML outlines to raw feed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from feedloom.functions import text as T

_TAG = r"""(?s)<outline\b((?:[^>"']|"[^"]*"|'[^']*')*)>"""
_OTHER = r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>"


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of a tag's inside; null where there is none."""
    found = rf"""(?s)(?:^|\s){name}\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    value = F.concat(F.regexp_extract(tag, found, 1), F.regexp_extract(tag, found, 2))
    return F.when(tag.rlike(found), T.unescape(value))


def read_opml(files: DataFrame) -> DataFrame:
    """Feeds of OPML documents in document order.

    ``files`` has ``file``, ``xml`` and, in one of two modes, ``category`` (the starting one)
    or ``country``. An outline without an address sets the category of the feeds after it;
    in country mode the country is the category throughout.
    """
    xml = T.fix_bare_ampersands(F.col("xml"))
    # Outlines count in document order, whatever their depth, so their tags tell all. A document
    # that is not well-formed gives none.
    sound = F.from_xml(xml, "body struct<_any:string>")["body"].isNotNull()
    tags = F.regexp_extract_all(F.regexp_replace(xml, _OTHER, ""), F.lit(_TAG), 1)
    d = files.select("file", "category", "country", F.posexplode(F.when(sound, tags)).alias("pos", "_tag")).select(
        "file", "category", "country", "pos",
        F.struct(*[_attribute(F.col("_tag"), n).alias(n) for n in ("text", "title", "xmlUrl", "description")]).alias("o"))
    label = F.coalesce("o.text", "o.title")
    is_feed = F.coalesce(F.col("o.xmlUrl") != "", F.lit(False))
    # A document is one file, so the running category stays within it.
    w = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    running = F.last(F.when(~is_feed, T.trim_ws(label)), ignorenulls=True).over(w)
    d = d.withColumn("_cat", F.when(F.col("country").isNotNull(), F.col("country")).otherwise(
        F.coalesce(running, "category", F.lit(""))))
    return d.filter(is_feed).select(
        "file", "pos", T.trim_ws(F.coalesce(label, F.lit("Untitled"))).alias("name"),
        T.trim_ws(F.col("o.xmlUrl")).alias("feed_url"),
        T.trim_ws(F.coalesce("o.description", F.lit(""))).alias("description"),
        F.col("_cat").alias("category"), "country", F.lit(None).cast("string").alias("site_url"),
    )


def read_opml_files(spark: SparkSession, path: str, by_country: bool = False) -> DataFrame:
    """OPML files of a folder; the file stem names the category or the country."""
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.opml$", 1)
    stem = F.url_decode(stem)
    none = F.lit(None).cast("string")
    files = spark.read.option("pathGlobFilter", "*.opml").text(path, wholetext=True).select(
        F.input_file_name().alias("file"), F.col("value").alias("xml"),
        (none if by_country else stem).alias("category"), (stem if by_country else none).alias("country"),
    )
    return read_opml(files)
