"""Library tables derived from the given ones, row by row, on Spark.

``documents`` stands for articles and feed items, ``events`` for user actions. Nothing is
sampled: each derived table has one row, or a fixed number of rows, per given row.
``derive_sql`` states the same rules for the comparison engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from feedloom import schema as S
from feedloom.session import spread

HIDDEN = S.SAVED_PAGES_ID


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def _title():
    return F.expr("coalesce(nullif(trim(regexp_extract(text, '^[^.\\\\n]*', 0)), ''), 'Untitled')")


def _url():
    return F.expr("concat('https://', source, '.example.com/', lang, '/', doc_id)")


def _published():
    return F.expr(
        "CASE WHEN doc_id % 7 <> 0 THEN timestamp'2024-01-01' + make_dt_interval(0, (doc_id * 37) % 720) END"
    )


def article(spark: SparkSession, sf_dir: str) -> DataFrame:
    return article_of(documents(spark, sf_dir))


def article_of(d: DataFrame) -> DataFrame:
    readable = "(doc_id div 7) % 10 NOT IN (7, 8, 9)"
    saved = "doc_id % 11 = 0"
    return d.select(
        F.expr("cast(doc_id AS string)").alias("id"),
        F.expr(f"CASE WHEN doc_id % 33 = 0 OR doc_id % 50 = 7 THEN '{HIDDEN}' ELSE source END").alias("source_id"),
        _title().alias("title"),
        _url().alias("article_url"),
        _published().alias("published_at"),
        F.expr("timestamp'2024-02-01' + make_dt_interval(0, 0, doc_id % 1440)").alias("added_at"),
        F.expr("CASE WHEN doc_id % 4 <> 0 THEN concat('https://img.example.com/', doc_id, '.jpg') END").alias("thumbnail_url"),
        F.expr(f"CASE WHEN {readable} THEN timestamp'2024-02-02' + make_dt_interval(0, 0, doc_id % 1440) END").alias("cached_at"),
        F.expr("CASE (doc_id div 7) % 10 WHEN 6 THEN 'partial' WHEN 7 THEN 'pending' WHEN 8 THEN 'failed' WHEN 9 THEN 'fetching' ELSE 'cached' END").alias("fetch_status"),
        F.expr("doc_id % 3 = 0").alias("is_read"),
        F.expr(saved).alias("is_saved"),
        F.expr(f"CASE WHEN {saved} THEN timestamp'2024-03-01' + make_dt_interval(0, 0, doc_id % 1440) END").alias("saved_at"),
        F.expr("CASE WHEN doc_id % 5 = 0 THEN concat('Wire ', lang) END").alias("original_source_name"),
        F.lit(None).cast("string").alias("original_source_icon_url"),
        F.expr(f"CASE WHEN {readable} THEN cast(n_chars AS int) END").alias("cache_size_bytes"),
        F.lit(None).cast("int").alias("last_http_status"),
        F.expr("CASE WHEN doc_id % 2 = 0 THEN concat('e', doc_id) END").alias("etag"),
        F.lit(None).cast("string").alias("last_modified"),
        F.expr("cast(doc_id % 4 AS int)").alias("retry_count"),
        F.expr("cast(greatest(1, (n_chars div 6 + 199) div 200) AS int)").alias("reading_minutes"),
        F.expr("CASE WHEN doc_id % 4 <> 3 THEN text END").alias("rss_content_html"),
    )


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = documents(spark, sf_dir).groupBy("source").agg(F.min("doc_id").alias("n0"))
    shown = per.select(
        F.col("source").alias("id"),
        F.expr("concat('Feed ', source)").alias("title"),
        F.expr("concat('https://', source, '.example.com/feed')").alias("feed_url"),
        F.expr("concat('https://www.', source, '.example.com/')").alias("site_url"),
        F.expr("CASE WHEN n0 % 2 = 0 THEN concat('https://', source, '.example.com/icon.png') END").alias("icon_url"),
        F.expr("timestamp'2024-01-01' + make_dt_interval(cast(n0 % 365 AS int))").alias("added_at"),
        F.expr("CASE WHEN n0 % 6 <> 0 THEN timestamp'2024-03-01 12:00:00' - make_dt_interval(0, 0, (n0 % 5) * 20) END").alias("last_fetched_at"),
        F.lit("automatic").alias("fetch_frequency"),
        F.expr("CASE WHEN n0 % 4 = 1 THEN 'failed' ELSE 'completed' END").alias("fetch_status"),
        F.expr("CASE n0 % 3 WHEN 0 THEN NULL WHEN 1 THEN 'standard' ELSE 'full' END").alias("cache_level"),
        F.lit(None).cast("string").alias("appearance_mode"),
        F.expr("CASE WHEN n0 % 2 = 1 THEN 'cards' END").alias("layout"),
        F.lit(None).cast("string").alias("home_layout"),
        F.lit(False).alias("is_collapsed"),
        F.expr("cast(n0 AS int)").alias("sort_order"),
    )
    hidden = spark.range(1).select(
        F.lit(HIDDEN).alias("id"), F.lit("Saved Pages").alias("title"),
        F.lit("saved-pages").alias("feed_url"), F.lit(-1).alias("sort_order"),
        F.lit(False).alias("is_collapsed"),
    )
    return shown.unionByName(hidden, allowMissingColumns=True)


def cached_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored page per readable article."""
    return article(spark, sf_dir).filter(F.col("fetch_status").isin(*S.READABLE)).select(
        F.col("id").alias("article_id"),
        F.expr("concat('/store/articles/', id, '/index.html')").alias("html_path"),
        F.expr("array(concat('shared', cast(id AS bigint) % 50), concat('own', id))").alias("asset_manifest"),
        "cached_at",
        F.expr("cast(cache_size_bytes AS bigint) * 2").alias("total_size_bytes"),
        F.lit(False).alias("is_truncated"),
        F.expr("CASE WHEN cast(id AS bigint) % 3 = 0 THEN 'full' ELSE 'standard' END").alias("cache_level_used"),
    )


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of the stored text per article; zero where the files were lost."""
    return documents(spark, sf_dir).select(
        F.expr("cast(doc_id AS string)").alias("article_id"),
        F.expr("CASE WHEN doc_id % 9 = 0 THEN 0 ELSE n_chars END").alias("content_chars"),
    )


def asset_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    shared = d.select(F.expr("concat('shared', doc_id % 60)").alias("asset_key")).distinct()
    return shared.unionByName(d.select(F.expr("concat('own', doc_id)").alias("asset_key")))


def feed_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item per document: known ones, moved ones, new ones, sign-in and aggregator links."""
    d = documents(spark, sf_dir).withColumn("_title", _title()).withColumn("_url", _url())
    return d.select(
        F.col("source").alias("source_id"),
        F.expr("concat('https://', source, '.example.com/feed')").alias("feed_url"),
        F.col("doc_id").alias("pos"),
        F.expr("CASE WHEN doc_id % 3 = 1 THEN concat(_title, ' (update ', doc_id, ')') ELSE _title END").alias("title"),
        F.expr("""CASE WHEN doc_id % 13 = 0 THEN concat('https://accounts.', source, '.example.com/login?n=', doc_id)
                       WHEN doc_id % 17 = 0 THEN concat('https://news.google.com/rss/articles/', doc_id)
                       WHEN doc_id % 3 = 1 THEN concat(_url, '/update')
                       WHEN doc_id % 5 = 0 THEN concat(_url, '?v=2') ELSE _url END""").alias("url"),
        _published().alias("published_at"),
        F.expr("CASE WHEN doc_id % 4 <> 0 THEN concat('https://img.example.com/', doc_id, '.jpg') END").alias("thumbnail_url"),
        F.lit(None).cast("string").alias("source_name"),
        F.col("text").alias("content_html"),
    )


def redirect(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).withColumn("_url", _url())
    return d.select(
        F.expr("concat('https://news.google.com/rss/articles/', doc_id)").alias("from_url"),
        F.expr("CASE WHEN doc_id % 2 = 0 THEN _url WHEN doc_id % 3 <> 0 THEN concat('https://real.example.org/', doc_id) END").alias("to_url"),
    )


def response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fetch attempt per article; a missing status means that no answer came."""
    return documents(spark, sf_dir).select(
        F.expr("cast(doc_id AS string)").alias("id"),
        F.expr("CASE doc_id % 12 WHEN 0 THEN 304 WHEN 1 THEN 404 ELSE 200 END").alias("status"),
        F.expr("CASE WHEN doc_id % 13 = 0 THEN 'application/json' ELSE 'text/html; charset=utf-8' END").alias("content_type"),
        F.expr("n_chars * 3").alias("body_bytes"),
        F.expr("CASE WHEN doc_id % 5 = 0 THEN concat('n', doc_id) END").alias("etag"),
        F.lit(None).cast("string").alias("last_modified"),
        F.col("n_chars").alias("text_chars"),
        F.expr("n_chars div 6").alias("word_count"),
        F.expr("doc_id % 8 = 0").alias("any_failed"),
        F.expr("n_chars div 2").alias("rss_chars"),
        F.expr("n_chars div 12").alias("rss_word_count"),
        F.expr("n_chars * 2").alias("total_bytes"),
    )


def user_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        "user_id",
        F.get_json_object("props", "$.k").alias("article_id"),
        F.expr("""CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'toggle_read'
                  WHEN 'purchase' THEN 'toggle_save' WHEN 'error' THEN 'fetch_failed'
                  ELSE 'subscribe' END""").alias("action"),
    )


# ---- feed documents, outlines and the directory --------------------------------------

CHUNK = 320


def _xml_text(c: str):
    """Text that is legal in XML: no control characters, no early end of a CDATA section."""
    clean = F.regexp_replace(F.col(c), r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "")
    return F.replace(clean, F.lit("]]>"), F.lit(""))


def feed_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSS documents made of all documents: one per source and run of 320 ids, so that a
    document stays small however large its source is."""
    from feedloom.functions.text import escape_html

    d = documents(spark, sf_dir).withColumn("_t", _title()).withColumn("_u", _url()).withColumn("_p", _published())
    link = F.expr("CASE WHEN doc_id % 6 = 5 THEN '' ELSE concat('<link>', _u, '</link>') END")
    guid = F.expr("concat('<guid isPermaLink=\"true\">', _u, '</guid>')")
    date = F.expr("CASE WHEN _p IS NULL THEN '' ELSE concat('<pubDate>', date_format(_p, 'EEE, dd MMM yyyy HH:mm:ss'), ' GMT</pubDate>') END")
    media = F.expr("CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN concat('<media:content url=\"/img/', doc_id, '.jpg\"/>') ELSE concat('<enclosure type=\"image/png\" url=\"https://img.example.com/', doc_id, '.png\"/>') END")
    body = F.concat(F.lit("<description><![CDATA["), _xml_text("text"), F.lit("]]></description>"))
    item = F.concat(F.lit("<item><title>"), escape_html(_xml_text("_t")), F.lit("</title>"), link, guid, date, media, body, F.lit("</item>"))
    grouped = d.select("source", F.expr(f"doc_id div {CHUNK}").alias("chunk"), F.struct("doc_id", item.alias("xml")).alias("it")).groupBy("source", "chunk").agg(
        F.array_sort(F.collect_list("it")).alias("items"))
    head = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?><rss version="2.0" xmlns:media="http://search.yahoo.com/mrss/"><channel><title>Feed '),
        F.col("source"), F.lit(" &amp; more</title><link>http://www."), F.col("source"), F.lit(".example.com/</link>"))
    return grouped.select(
        F.expr("concat('https://', source, '.example.com/feed/', chunk, '.xml')").alias("feed_url"),
        F.concat(head, F.array_join(F.transform("items", lambda i: i["xml"]), ""), F.lit("</channel></rss>")).alias("xml"),
    )


def atom_xml(spark: SparkSession, sf_dir: str, broken: bool = False) -> DataFrame:
    """Atom documents made of all documents, one per source and run of 320 ids, an entry a line.

    Entries differ in the order of their links, dates and contents. With ``broken``, the end tag
    of every entry whose id ends in 49 or 99 is misspelt.
    """
    from feedloom.functions.text import escape_html

    d = documents(spark, sf_dir).withColumn("_t", _title()).withColumn("_u", _url()).withColumn("_p", F.coalesce(_published(), F.expr("timestamp'2024-02-01'")))
    stamp = lambda x: f"date_format({x}, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
    first, later = stamp("_p"), stamp("_p + interval 1 day")
    link = F.expr("""CASE doc_id % 3
        WHEN 0 THEN concat('<link rel="enclosure" href="/e"/><link href="', _u, '"/>')
        WHEN 1 THEN concat('<link rel="alternate" href="', _u, '/old"/><link rel="alternate" href="', _u, '"/>')
        ELSE concat('<link rel="alternate" href=""/><guid>', _u, '</guid>') END""")
    date = F.expr(f"""CASE doc_id % 4
        WHEN 0 THEN concat('<updated>', {later}, '</updated><published>', {first}, '</published>')
        WHEN 1 THEN concat('<published>', {first}, '</published><updated>', {later}, '</updated>')
        WHEN 2 THEN concat('<dc:date>', {later}, '</dc:date><published>', {first}, '</published>')
        ELSE concat('<updated/><published>', {first}, '</published>') END""")
    body = F.concat(F.lit("<![CDATA["), _xml_text("text"), F.lit("]]>"))
    content = F.when(F.expr("doc_id % 2 = 0"), F.concat(
        F.lit("<description>in short</description><content:encoded>"), body, F.lit("</content:encoded><content>more</content>"))).otherwise(
        F.concat(F.lit("<content>"), body, F.lit("</content><description>in short</description>")))
    end = F.when(F.expr("doc_id % 50 = 49") & F.lit(broken), "</entri>").otherwise("</entry>")
    entry = F.concat(F.lit("\n<entry><title>"), escape_html(_xml_text("_t")), F.lit("</title>"), link, date, content, end)
    grouped = d.select("source", F.expr(f"doc_id div {CHUNK}").alias("chunk"), F.struct("doc_id", entry.alias("xml")).alias("it")).groupBy("source", "chunk").agg(
        F.array_sort(F.collect_list("it")).alias("items"))
    return grouped.select(
        F.expr("concat('https://', source, '.example.com/atom/', chunk, '.xml')").alias("feed_url"),
        F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom" xmlns:dc="d" xmlns:content="c"><title>Feed</title><link href="/"/>'),
                 F.array_join(F.transform("items", lambda i: i["xml"]), ""), F.lit("</feed>")).alias("xml"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages")).withColumnRenamed("url", "page_url")


def _host(u: str = "page_url") -> str:
    return f"regexp_extract({u}, '^https?://([^/?#]+)', 1)"


def directory_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One directory entry per page; entries of one host and language share an address."""
    p = pages(spark, sf_dir).withColumn("_h", F.expr(_host())).withColumn(
        "_l", F.expr("regexp_extract(page_url, '^https?://[^/?#]+/([a-z]{2})/', 1)"))
    return p.select(
        F.expr("concat('d', page_id)").alias("id"),
        F.expr("regexp_extract(html, '<title>([^<]*)</title>', 1)").alias("name"),
        F.expr("concat(CASE WHEN page_id % 4 = 0 THEN 'http' ELSE 'https' END, '://', _h, '/', _l, '/feed', CASE WHEN page_id % 5 = 0 THEN '/' ELSE '' END)").alias("feed_url"),
        F.expr("CASE WHEN page_id % 9 <> 0 THEN concat('http://', _h, '/') END").alias("site_url"),
        F.expr("regexp_extract(html, '<div class=\"ad\">([^<]*)</div>', 1)").alias("description"),
        F.expr("CASE _l WHEN 'en' THEN 'Tech' WHEN 'fr' THEN 'Science' WHEN 'de' THEN 'Germany' ELSE 'Spain' END").alias("category"),
        F.expr("CASE _l WHEN 'de' THEN 'Germany' WHEN 'es' THEN 'Spain' END").alias("country"),
        F.expr("array(_l, regexp_extract(_h, '([^.]+)[.]example[.]', 1))").alias("tags"),
        F.expr("CASE WHEN page_id % 6 <> 0 THEN date_add(date'2024-01-01', cast((page_id * 13) % 180 AS int)) END").alias("last_verified"),
        F.col("page_id").alias("pos"),
    )


def feed_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch attempts per directory address: a first one, and a second where the first failed."""
    d = directory_feed(spark, sf_dir).groupBy(F.col("feed_url").alias("url")).agg(F.min("pos").alias("k"))
    item = "concat('<item><link>', url, '/a', i, '</link><pubDate>', date_format(timestamp'2024-06-01' - make_dt_interval(cast(k % 10 AS int) * 40 + i), 'dd MMM yyyy HH:mm:ss'), ' GMT</pubDate></item>')"
    rss = f"concat('<?xml version=\"1.0\"?><rss><channel><title>T</title><link>', url, '/home</link>', array_join(transform(sequence(0, 11), i -> {item}), ''), '</channel></rss>')"
    first = d.select(
        "url", F.lit(1).alias("attempt"),
        F.expr("CASE WHEN k % 5 = 0 THEN 503 ELSE 200 END").alias("status"),
        F.expr("CASE WHEN k % 7 = 0 THEN concat('http://', regexp_extract(url, '://(.*)$', 1)) ELSE concat('https://', regexp_extract(url, '://(.*)$', 1)) END").alias("final_url"),
        F.expr(f"CASE WHEN k % 11 = 0 THEN '<html><body>gone</body></html>' WHEN k % 13 = 0 THEN replace({rss}, '</channel>', '') ELSE {rss} END").alias("body"),
        "k",
    )
    again = first.filter("status = 503").withColumn("attempt", F.lit(2)).withColumn(
        "status", F.expr("CASE WHEN k % 2 = 0 THEN 200 ELSE 503 END"))
    return first.unionByName(again)


def opml_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outline documents over all directory entries, one per run of 64 entries and mode."""
    from feedloom.functions.text import escape_html

    d = directory_feed(spark, sf_dir)
    # The ampersand stays bare, as it often is in such files.
    label = F.replace(escape_html(F.col("name")), F.lit("&amp;"), F.lit("&"))
    cell = F.concat(
        F.expr("CASE WHEN pos % 8 = 0 THEN concat('<outline text=\"Group ', pos, '\"/>') ELSE '' END"),
        F.lit('<outline text="'), label, F.lit('" xmlUrl="'), F.col("feed_url"), F.lit('" description=" d" />'))
    rows = d.select(F.expr("pos div 64").alias("n"), F.struct("pos", cell.alias("x")).alias("c")).groupBy("n").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["x"]), "").alias("_o"))
    xml = F.concat(F.lit("<opml><head/><body><outline text=\"All\">"), F.col("_o"), F.lit("</outline></body></opml>"))
    by_topic = rows.select(F.expr("concat('topic-', n)").alias("file"), xml.alias("xml"),
                           F.lit("Start").alias("category"), F.lit(None).cast("string").alias("country"))
    by_country = rows.select(F.expr("concat('country-', n)").alias("file"), xml.alias("xml"),
                             F.lit(None).cast("string").alias("category"), F.expr("concat('Land ', n)").alias("country"))
    return by_topic.unionByName(by_country)
