"""SRC-01 to SRC-03: feed documents to headers and items, from their elements in document order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedloom.functions import media, text as T, urls
from feedloom.sources.xml_events import feed_document

MIN_CONTENT = 100
CHECKED_ITEMS = 10

_DATES = ("pubdate", "published", "updated", "dc:date")


def parse_feeds(raw: DataFrame) -> DataFrame:
    """Adds ``doc``, the document's events in order, and ``is_atom``. ``raw`` has feed_url and xml.

    Documents that are not well formed have ``doc.error``: the line and message of the first error.
    """
    return raw.withColumn("doc", feed_document(F.col("xml"))).withColumn("is_atom", F.coalesce("doc.is_atom", F.lit(False)))


def well_formed() -> Column:
    return F.col("doc").isNotNull() & F.col("doc.error").isNull()


def malformed_detail() -> Column:
    """Where and why a document is not well formed."""
    return F.concat(F.lit("line "), F.col("doc.error.line").cast("string"), F.lit(": "), F.col("doc.error.message"))


def _texts(events: Column, *tags: str) -> Column:
    return F.transform(F.filter(events, lambda e: e["tag"].isin(*tags)), lambda e: e["text"])


def _is_alternate(e: Column) -> Column:
    return (e["tag"] == "link") & (F.coalesce(e["rel"], F.lit("alternate")) == "alternate")


def _fold(events: Column, *rules) -> Column:
    """A text that the events change one after another, empty at first: each rule, given the
    event and the text so far, says whether it applies and what the text becomes."""
    def step(text: Column, e: Column) -> Column:
        out = text
        for rule in reversed(rules):
            applies, value = rule(e, text)
            out = F.when(F.coalesce(applies, F.lit(False)), F.coalesce(value, F.lit(""))).otherwise(out)
        return out

    return F.aggregate(events, F.lit(""), step)


def _first_of(*tags: str):
    return lambda e, text: (e["tag"].isin(*tags) & (text == ""), e["text"])


def feed_headers(parsed: DataFrame) -> DataFrame:
    """Header of every valid feed: decoded title, else the host, and the site address. Both are
    the first that stand before the first item."""
    title = F.get(_texts(F.col("doc.head"), "title"), F.lit(0))
    rss_site = F.get(F.filter(_texts(F.col("doc.head"), "link"), lambda x: x != ""), F.lit(0))
    atom_site = F.get(F.filter("doc.head", _is_alternate), F.lit(0))["href"]
    valid = well_formed() & (title.isNotNull() | (F.size("doc.items") > 0))
    site = F.when(F.col("is_atom"), atom_site).otherwise(rss_site)
    d = parsed.filter(F.coalesce(valid, F.lit(False))).withColumn("_site", site).withColumn("_title", title)
    return d.select(
        "feed_url",
        F.coalesce(T.decode_entities(F.col("_title")), urls.host(F.col("feed_url")), F.lit("Untitled")).alias("title"),
        urls.resolve_url(F.col("feed_url"), F.col("_site")).alias("site_url"),
    )


def raw_items(parsed: DataFrame) -> DataFrame:
    """One row per item in document order, each field as the item's elements leave it, in order.

    The last title and the last address count, an empty one too; a guid fills in while the
    address is empty. Of dates and sources the first with text counts, of full contents the
    last, else the first content or description; the last media address, else the first image
    enclosure.
    """
    d = parsed.filter(well_formed()).select("feed_url", "is_atom", F.posexplode("doc.items").alias("pos", "ev"))
    ev, atom = F.col("ev"), F.col("is_atom")
    address = F.when(atom, _fold(
        ev, lambda e, u: (_is_alternate(e), e["href"]), lambda e, u: ((e["tag"] == "guid") & (u == ""), e["text"])
    )).otherwise(_fold(ev, lambda e, u: (e["tag"] == "link", e["text"]), lambda e, u: ((e["tag"] == "guid") & (u == ""), e["text"])))
    content = _fold(ev, lambda e, c: ((e["tag"] == "content:encoded") & (e["text"] != ""), e["text"]), _first_of("content", "description"))
    thumb = _fold(
        ev, lambda e, u: (e["tag"].isin("media:thumbnail", "media:content") & (e["url"] != ""), e["url"]),
        lambda e, u: ((e["tag"] == "enclosure") & (u == "") & e["type"].startswith("image/") & e["url"].isNotNull(), e["url"]))
    return d.select(
        "feed_url", "pos", "is_atom", _fold(ev, lambda e, t: (e["tag"] == "title", e["text"])).alias("raw_title"), address.alias("raw_url"),
        _fold(ev, _first_of(*_DATES)).alias("raw_date"), thumb.alias("raw_thumbnail"), content.alias("raw_content"),
        _fold(ev, _first_of("source")).alias("raw_source"), "ev",
    )


def finalize_items(items: DataFrame) -> DataFrame:
    """SRC-02: items with an address; titles decoded, thumbnails found, short content dropped."""
    base = F.col("feed_url")
    d = items.withColumn("url", urls.resolve_url(base, F.col("raw_url"))).filter(F.col("url").isNotNull())
    d = d.withColumn("_img", media.first_image_src(F.col("raw_content")))
    name = F.nullif("raw_source", F.lit(""))
    return d.select(
        "feed_url", "pos",
        F.when(F.col("raw_title") == "", F.col("url")).otherwise(T.decode_entities(F.col("raw_title"))).alias("title"),
        "url", T.parse_feed_date(F.col("raw_date")).alias("published_at"),
        F.coalesce(urls.resolve_url(base, F.col("raw_thumbnail")), urls.resolve_url(base, F.col("_img"))).alias("thumbnail_url"),
        T.decode_entities(name).alias("source_name"),
        F.when(F.length("raw_content") > MIN_CONTENT, F.col("raw_content")).alias("content_html"),
    )


def read_feeds(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-01: headers and items of valid feeds."""
    parsed = parse_feeds(raw)
    return feed_headers(parsed), finalize_items(raw_items(parsed))


def read_feed_check_items(parsed: DataFrame) -> DataFrame:
    """SRC-03: per feed, the newest date and the addresses of its first ten items.

    Only web addresses count; a guid stands in where no link is one. The last publication date
    that can be read counts, else the first of the other dates.
    """
    i = parsed.filter(well_formed()).select("feed_url", "is_atom", F.posexplode("doc.items").alias("pos", "ev")).filter(F.col("pos") < CHECKED_ITEMS)
    ev = F.col("ev")
    link = F.when(F.col("is_atom"), _fold(ev, lambda e, u: (_is_alternate(e) & e["href"].startswith("http"), T.trim_ws(e["href"])))).otherwise(
        _fold(ev, lambda e, u: ((e["tag"] == "link") & e["text"].startswith("http"), e["text"])))
    guid = _fold(ev, lambda e, u: ((e["tag"] == "guid") & (u == "") & e["text"].startswith("http"), e["text"]))
    dates = lambda *tags: F.array_compact(F.transform(_texts(ev, *tags), lambda x: T.parse_feed_date(x, without_seconds=True)))
    i = i.select(
        "feed_url", "pos", F.coalesce(F.nullif(link, F.lit("")), F.nullif(guid, F.lit(""))).alias("url"),
        F.coalesce(F.try_element_at(dates("pubdate"), F.lit(-1)), F.get(dates("published", "updated", "dc:date", "date"), F.lit(0))).alias("item_date"))
    got = i.groupBy("feed_url").agg(
        F.max("item_date").alias("newest_item_date"),
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("url").isNotNull(), F.struct("pos", "url")))), lambda x: x["url"]
        ).alias("article_urls"),
    )
    return parsed.select("feed_url").join(got, "feed_url", "left").withColumn(
        "article_urls", F.coalesce("article_urls", F.array().cast("array<string>"))
    )


def newest_item(items: DataFrame) -> DataFrame:
    """AGG-05: latest item date per feed."""
    return items.groupBy("feed_url").agg(F.max("published_at").alias("newest_item_date"))


def site_url(parsed: DataFrame) -> DataFrame:
    """EXT-37: home page a feed names: first web link of the channel, or first alternate link."""
    own = F.concat("doc.head", "doc.tail")
    links = F.concat(_texts(F.filter(own, lambda e: e["around"] == "channel"), "link"), _texts(F.flatten("doc.items"), "link"))
    rss = F.get(F.filter(links, lambda x: x.startswith("http")), F.lit(0))
    atom = F.get(F.filter(own, lambda e: _is_alternate(e) & (e["around"] == "feed") & F.coalesce(e["href"] != "", F.lit(False))), F.lit(0))["href"]
    return parsed.select("feed_url", F.when(F.col("is_atom"), T.trim_ws(atom)).otherwise(rss).alias("site_url"))


def read_feed_files(spark, path: str) -> DataFrame:
    """Whole feed files as (feed_url, xml); the file name stands for the address."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("feed_url"), F.col("value").alias("xml")
    )
