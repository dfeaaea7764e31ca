from datetime import datetime

from pyspark.sql import functions as F

from feedloom.operators import directory as D
from feedloom.sources import feeds, opml, tables

RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:media="m" xmlns:content="c" xmlns:dc="d"><channel>
<title>Feed &amp; Co</title><link>http://site.example.com/</link>
<item><title>Late &lt;b&gt;link&lt;/b&gt;</title><guid>https://g.example.com/1</guid><link>/one</link><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate>
  <description>short</description><content:encoded><![CDATA[<p>%s</p><img src="/i.jpg">]]></content:encoded></item>
<item><title></title><guid>https://g.example.com/2</guid><media:content url=""/><media:thumbnail url="/t.jpg"/></item>
<item><title>Emptied</title><guid>https://g.example.com/3</guid><link></link></item>
<item><title>Filled</title><link></link><guid>https://g.example.com/4</guid><dc:date>2024-01-02T00:00:00Z</dc:date><enclosure type="image/png" url="/e.png"/></item>
</channel></rss>""" % ("x" * 120)
ATOM = """<feed xmlns="a"><title>Atom</title><link rel="self" href="/self"/><link href="https://home.example.com/"/>
<entry><title>E</title><link rel="alternate" href="/a"/><link rel="enclosure" href="/z"/><link rel="alternate" href="/b"/>
<updated>2024-02-02T00:00:00Z</updated><published>2024-02-01T00:00:00Z</published><content type="html">c</content></entry></feed>"""


def raw(spark):
    return spark.createDataFrame(
        [("https://f.example.com/rss", RSS), ("https://f.example.com/atom", ATOM),
         ("https://f.example.com/bad", RSS.replace("</item>", "", 1)), ("https://f.example.com/none", "<html></html>")],
        "feed_url string, xml string")


def test_items_and_headers(spark):
    headers, items = feeds.read_feeds(raw(spark))
    assert {(r.feed_url[-4:], r.title, r.site_url) for r in headers.collect()} == {
        ("/rss", "Feed & Co", "https://site.example.com/"), ("atom", "Atom", "https://home.example.com/")}
    rows = {(r.feed_url[-4:], r.pos): r for r in items.collect()}
    assert set(rows) == {("/rss", 0), ("/rss", 1), ("/rss", 3), ("atom", 0)}
    one, two, four, atom = rows["/rss", 0], rows["/rss", 1], rows["/rss", 3], rows["atom", 0]
    assert (one.title, one.url, one.published_at) == ("Late link", "https://f.example.com/one", datetime(2024, 1, 1, 10))
    assert one.thumbnail_url == "https://f.example.com/i.jpg" and one.content_html.startswith("<p>xxx")
    assert (two.title, two.url, two.thumbnail_url) == ("https://g.example.com/2", "https://g.example.com/2", "https://f.example.com/t.jpg")
    assert (four.url, four.published_at, four.thumbnail_url) == ("https://g.example.com/4", datetime(2024, 1, 2), "https://f.example.com/e.png")
    assert (atom.url, atom.published_at, atom.content_html) == ("https://f.example.com/b", datetime(2024, 2, 2), None)


def test_feed_checks(spark):
    log = raw(spark).select(
        F.col("feed_url").alias("url"), F.col("feed_url").alias("final_url"), F.lit(200).alias("status"), F.col("xml").alias("body"))
    got = {r.feed_url.rsplit("/", 1)[1]: r for r in D.validate_feeds(log).collect()}
    assert got["rss"].is_valid and got["rss"].newest_item_date == datetime(2024, 1, 2)
    assert got["rss"].article_urls == [f"https://g.example.com/{i}" for i in (1, 2, 3, 4)]
    assert got["bad"].issue.kind == "malformedXML" and got["none"].issue.kind == "notAFeed"
    assert got["rss"].found_site_url == "http://site.example.com/"


def test_opml_modes(spark):
    xml = ('<opml><body><outline text="Food & Drink"><outline text="A" title="T" xmlUrl=" https://a.example.com/f?x=1&y=2 "/></outline>'
           '<outline title="Only title" xmlUrl="https://b.example.com" description=" d "/></body></opml>')
    files = spark.createDataFrame([("t", xml, "Start", None), ("c", xml, None, "Spain")], "file string, xml string, category string, country string")
    rows = {(r.file, r.pos): (r.name, r.feed_url, r.description, r.category, r.country) for r in opml.read_opml(files).collect()}
    assert rows["t", 1] == ("A", "https://a.example.com/f?x=1&y=2", "", "Food & Drink", None)
    assert rows["t", 2] == ("Only title", "https://b.example.com", "d", "Food & Drink", None)
    assert rows["c", 1][3:] == ("Spain", "Spain")


def test_directory_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "tech.json").write_text(
        '[{"id":"1","name":"b","feedURL":"http://x/f","siteURL":null,"description":"","category":"Tech","country":null,"tags":["t"],"lastVerified":"2024-01-01"},'
        '{"id":"2","name":"A","feedURL":"http://y/f","description":"","category":"Tech","tags":[]}]')
    rows = tables.read_directory(spark, str(tmp_path / "in"))
    assert [(r.id, r.slug, r.tags) for r in rows.orderBy("id").collect()] == [("1", "tech", ["t"]), ("2", "tech", [])]
    assert [r.id for r in tables.published_feeds(rows).collect()] == ["2", "1"]
    tables.write_directory(rows.drop("slug"), str(tmp_path / "out"))
    assert tables.read_directory(spark, str(tmp_path / "out" / "*"), arrays=False).count() == 2


def test_quality_rules(spark):
    def rows(feed, *pages):
        return [(feed, w, i, p) for w, i, p in pages]

    data = (rows("ok", (300, 0, 0), (400, 0, 9)) + rows("thin", (150, 1, 0), (151, 2, 0)) + rows("wall", (150, 9, 3), (199, 9, 3))
            + rows("rich", (150, 3, 0), (150, 4, 0)) + rows("low", (99, 9, 0), (99, 9, 0)) + rows("one", (5, 0, 0)))
    sig = spark.createDataFrame(data, "feed_url string, word_count int, image_count int, paywall_score int")
    feeds_df = spark.createDataFrame([(f,) for f in ("ok", "thin", "wall", "rich", "low", "one", "blocked")], "feed_url string")
    got = {r.feed_url: (r.reason, r.is_acceptable) for r in D.feed_quality(sig, feeds_df).collect()}
    assert got == {"ok": ("ok", True), "thin": ("thin", False), "wall": ("paywalled", False), "rich": ("image_rich", True),
                   "low": ("very_thin", False), "one": ("too_few", True), "blocked": ("blocked", False)}


def test_opml_outlines_of_any_depth(spark):
    deep = '<outline text="Deep" xmlUrl="https://deep.example.com/f"/>'
    for k in range(6, 0, -1):
        deep = f"<outline text='L{k} &amp; more'>{deep}</outline>"
    xml = f"<opml><body>{deep}<!-- <outline text='no' xmlUrl='https://no.example.com'/> --></body></opml>"
    rows = spark.createDataFrame([("a", xml, "start", None), ("bad", "<opml><body><outline text='x' xmlUrl='https://x'></body>", "s", None)],
                                 "file string, xml string, category string, country string")
    got = [(r.feed_url, r.category) for r in opml.read_opml(rows).collect()]
    assert got == [("https://deep.example.com/f", "L6 & more")]


def one_item(spark, body, feed="rss"):
    xml = f"<rss xmlns:m='m'><channel><title>T</title><item>{body}</item></channel></rss>" if feed == "rss" else f"<feed><title>T</title><entry>{body}</entry></feed>"
    return feeds.raw_items(feeds.parse_feeds(spark.createDataFrame([("https://f.example.com/x", xml)], "feed_url string, xml string"))).first()


def test_order_across_elements(spark):
    r = one_item(spark, "<dc:date>2024-01-05T00:00:00Z</dc:date><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate><guid>g</guid><link></link>"
                        "<description>d</description><content>c</content><source> </source><source>S</source>")
    assert (r.raw_date, r.raw_url, r.raw_content, r.raw_source) == ("2024-01-05T00:00:00Z", "", "d", "S")
    r = one_item(spark, "<link/><guid> </guid><guid>g2</guid><guid>g3</guid><content:encoded>one</content:encoded><description>d</description>"
                        "<content:encoded>two</content:encoded><content:encoded> </content:encoded><TITLE>a</TITLE><title>b<i>x</i>c</title>")
    assert (r.raw_url, r.raw_content, r.raw_title) == ("g2", "two", "c")
    r = one_item(spark, "<updated/><published>p</published><updated>u</updated><link rel='self' href='s'/><link href='a'/><link rel='alternate'/><guid>g</guid>", "atom")
    assert (r.is_atom, r.raw_date, r.raw_url) == (True, "p", "g")
    r = one_item(spark, "<enclosure type='audio/mp3' url='x'/><enclosure type='image/png' url='i'/><media:group><media:content url='m'/></media:group>"
                        "<enclosure type='image/png' url='j'/><media:thumbnail url=''/>")
    assert r.raw_thumbnail == "m"


def test_headers_stand_before_the_first_item(spark):
    xml = ("<rss><channel><image><title>Logo</title><link> </link></image><title>Feed</title><link>/home</link>"
           "<item><title>I</title></item><link>https://late.example.com</link></channel></rss>")
    parsed = feeds.parse_feeds(spark.createDataFrame([("https://f.example.com/x", xml), ("https://g.example.com/y", None)], "feed_url string, xml string"))
    assert [(r.title, r.site_url) for r in feeds.feed_headers(parsed).collect()] == [("Logo", "https://f.example.com/home")]
    assert {r.feed_url[8]: r.site_url for r in feeds.site_url(parsed).collect()} == {"f": "https://late.example.com", "g": None}


def test_errors_have_a_line_and_a_message(spark):
    cases = {"<rss>\n<channel>\n</rss>": (3, "mismatched tag"), "<a>&nbsp;</a>": (1, "undefined entity"), "": (1, "no element found"), "<a>\n\n<b x=1/></a>": (3, "not well-formed (invalid token)"),
             "<a/>\n<b/>": (2, "junk after document element"), "\n<?xml version='1.0'?><a/>": (2, "XML or text declaration not at start of entity"),
             "<a><b></a>": (1, "mismatched tag"), "<a>" * 3: (1, "no element found"), "<?xml version='1.0' encoding='ISO-8859-1'?><a>\u00e9</a>": None}
    rows = spark.createDataFrame([(str(i), x) for i, x in enumerate(cases)], "feed_url string, xml string")
    got = {r.feed_url: r.error and (r.error.line, r.error.message) for r in feeds.parse_feeds(rows).select("feed_url", "doc.error").collect()}
    assert got == {str(i): e for i, e in enumerate(cases.values())}


def test_events_leave_a_worker_in_pieces(spark):
    """One batch of many large documents is not held as a whole; nulls and order stay."""
    import pyarrow as pa
    from feedloom.sources import xml_events as X

    size = X.PIECE_CHARS // 2
    texts = [None if k % 5 == 4 else f"<rss><channel><title>{k}</title><item><title>{'x' * size}</title></item></channel></rss>" for k in range(12)]
    pieces = list(X.event_arrays(iter([pa.array(texts), pa.array([], pa.string())])))
    assert max(len(p) for p in pieces) <= 3 and sum(len(p) for p in pieces) == len(texts)
    rows = [r for p in pieces for r in p.to_pylist()]
    assert [r and r["head"][0]["text"] for r in rows] == [None if t is None else str(k) for k, t in enumerate(texts)]
    raw = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "feed_url string, xml string").coalesce(1)
    assert {r.feed_url: r.n for r in feeds.parse_feeds(raw).selectExpr("feed_url", "size(doc.items) n").collect()} == {
        str(k): None if t is None else 1 for k, t in enumerate(texts)}
