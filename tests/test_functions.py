from datetime import datetime

import pytest
from pyspark.sql import functions as F

from feedloom.functions import media, names, text as T, urls


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda *cols: list(one.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


L = F.lit


def test_url_normalisers_differ(value):
    app, tool = value(
        urls.normalize_url(L("HTTPS://WWW.Ex.com/A/?q=1#f")), urls.normalize_feed_url(L("https://WWW.ex.com/A/")))
    assert app == "//ex.com/A?q=1"
    assert tool == "www.ex.com/a"


def test_resolve_url(value):
    got = value(
        urls.resolve_url(L("http://a.com/x/y.html?z"), L("../q/./r")), urls.resolve_url(L("http://a.com"), L("q")),
        urls.resolve_url(L("https://a.com/x"), L("//b.com/c")), urls.resolve_url(L("https://a.com/x"), L("")),
        urls.resolve_url(L("https://a.com/p/x"), L("?n=2")))
    assert got == ["https://a.com/q/r", "https://a.com/q", "https://b.com/c", None, "https://a.com/p/x?n=2"]


def test_non_article_urls(value):
    assert value(*[urls.is_non_article_url(L(u)) for u in (
        "https://accounts.x.com/a", "https://x.com/login/", "https://x.com/loginpage", "https://x.com/a?return_to=b",
        "https://x.com/preferences/notifications")]) == [True, True, False, True, True]


@pytest.mark.parametrize("minutes, label", [
    (0, None), (1, "5min"), (4, "5min"), (8, "8min"), (57, "55min"), (58, "1hr"), (93, "1hr 35min"),
    (298, "5hr"), (300, "5hr+")])
def test_format_minutes(value, minutes, label):
    assert value(T.format_minutes(L(minutes))) == [label]


@pytest.mark.parametrize("then, label", [
    ("2024-03-10 11:59:01", "Just now"), ("2024-03-10 11:59:00", "1m ago"), ("2024-03-10 11:00:00", "1h ago"),
    ("2024-03-09 12:00:01", "23h ago"), ("2024-03-09 10:00:00", "Yesterday"), ("2024-03-08 23:00:00", "2 days ago"),
    ("2024-03-04 00:00:00", "6 days ago"), ("2024-03-03 00:00:00", "Last Mar 3, 2024"), ("2024-03-10 12:00:01", "Last Mar 10, 2024")])
def test_relative_time(value, then, label):
    ts, now = F.expr(f"timestamp'{then}'"), F.expr("timestamp'2024-03-10 12:00:00'")
    assert value(T.relative_time(ts, now, "Last")) == [label]


def test_feed_dates(value):
    got = value(*[T.parse_feed_date(L(s), True) for s in (
        "Mon, 01 Jan 2024 10:00:00 EST", "1 Jan 2024 10:00:00 +0200", "2024-01-01T10:00:00.25Z", "Mon, 01 Jan 2024 10:00 GMT", "soon")])
    assert got == [datetime(2024, 1, 1, 15), datetime(2024, 1, 1, 8), datetime(2024, 1, 1, 10, 0, 0, 250000), datetime(2024, 1, 1, 10), None]


def test_entities_decode_once(value):
    assert value(T.decode_entities(L("a &amp;lt; b &lt;c&gt; &#8217; &#x1F600; &eacute;")), T.decode_entities(L("plain"))) == [
        "a &lt; b <c> ’ 😀 é", "plain"]


def test_srcset(value):
    entries, best, density, first, none = value(
        media.parse_srcset(L("https://a/w_640,c_limit/i.jpg 300w, https://a/w_1200,c/i.jpg 1200w")),
        media.pick_srcset(L("a.jpg 300w, b.jpg 1400w, c.jpg 1200w, d.jpg 2000w")), media.pick_srcset(L("a.jpg 1x, b.jpg 2x")),
        media.pick_srcset(L("a.jpg")), media.pick_srcset(L("")))
    assert entries == ["https://a/w_640,c_limit/i.jpg 300w", "https://a/w_1200,c/i.jpg 1200w"]
    assert (best, density, first, none) == ("c.jpg", "b.jpg", "a.jpg", None)
    assert value(media.pick_srcset(L("a.jpg 1600w, b.jpg 3000w"))) == ["a.jpg"]


def test_paragraphs(value):
    got = value(T.add_paragraphs(L("A b. C d! E f? G h. I.")), T.add_paragraphs(L("x\n\ny")), T.add_paragraphs(L("x\ny")), T.add_paragraphs(L("x")))
    assert got == ["<p>A b. C d! E f?</p>\n<p>G h. I.</p>", "<p>x</p>\n<p>y</p>", "<p>x</p>\n<p>y</p>", "<p>x</p>"]


def test_ampersands_and_slugs(value):
    assert value(T.fix_bare_ampersands(L("a & b &amp; &#39; &copy;")), T.slugify(L("Business & Économie")), T.slugify(L("Business & Économie"), True)) == [
        "a &amp; b &amp; &#39; &amp;copy;", "business-économie", "business-conomie"]


def test_simplify_name(spark):
    rows = [
        ("Design Milk | Modern design and art blog", "https://design-milk.com/feed", "Design Milk"),
        ("News - BBC", "https://bbc.co.uk/", "BBC"), ("The Best Food My Site Has Ever Made", "https://mysite.com/f", "My Site"),
        ("a b c d e f g", "https://zz.com", "a b c"), ("Acme| Blog", "https://x.com", "Acme"),
        ("One two three four: five six seven", "https://nomatch.org", "One two three"), ("Short", "x", "Short")]
    df = spark.createDataFrame(rows, "n string, u string, want string")
    for r in names.with_simple_name(df, "n", "u").collect():
        assert r.simple_name == r.want, r


def test_descriptions(value):
    long = "word " * 40
    refined, picked = value(
        T.refine_description(L("Current text here."), L(long)),
        T.pick_description(L("n"), L("Current text."), L("Casino bonanza for everyone"), L(None).cast("string"), L(False)))
    assert refined == ("word " * 24).strip()[:119].rstrip() and len(refined) <= 120
    assert picked == "Current text"


def test_asset_names_and_keys(value):
    base, url_param, two_seg, generic = value(
        media.base_path_key(L("https://a.com/x.jpg?w=1&ID=2")), media.base_path_key(L("https://a.com/cdn?url=u1&w=2")),
        media.host_file_key(L("https://a.com/h/x.jpg")), media.host_file_key(L("https://a.com/a/b/640x480.jpg")))
    assert (base, url_param, two_seg, generic) == ("https://a.com/x.jpg?ID=2", "https://a.com/cdn?url=u1", "a.com/h/x.jpg", None)
