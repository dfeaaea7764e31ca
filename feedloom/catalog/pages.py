"""Queries over page extraction.

Every given page gets a marked fragment at the end of its article, chosen by its number, and
is parsed and cleaned as a whole. Marked elements have ids beginning with ``x``; a query lists
those that survive, so the comparison can state what must be left of each page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedloom.catalog import derive as D
from feedloom.catalog.registry import big, query
from feedloom.functions import text as T, urls
from feedloom.operators import dom, embedded, extract as E, page_rules as R
from feedloom.operators.dom import node_tag, attr
from feedloom.plans import extract_job as J
from feedloom.session import materialize
from feedloom.sources.html import parse_nodes


def illustrated(spark, sf, fragments: list[str]) -> DataFrame:
    """Pages with a fragment put before the end of their article; ``{p}`` is the page number."""
    choice = F.element_at(F.array(*[F.lit(f) for f in fragments]), (F.col("page_id") % len(fragments) + 1).cast("int"))
    piece = F.replace(choice, F.lit("{p}"), F.col("page_id").cast("string"))
    return D.pages(spark, sf).withColumn(
        "html", F.replace("html", F.lit("</article>"), F.concat(piece, F.lit("</article>"))))


def marks(nodes: DataFrame, value: Column | None = None) -> DataFrame:
    """Surviving marked elements of every page, in document order."""
    shown = attr("id") if value is None else F.concat(attr("id"), F.lit("="), value)
    rows = nodes.filter(attr("id").startswith("x")).select("page_id", F.struct("pre", shown.alias("m")).alias("s"))
    return rows.groupBy("page_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["m"]), " ").alias("marks"))


def expected(*answers: str) -> str:
    """Comparison SQL: the marks by page number."""
    cases = " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(answers))
    body = f"CASE page_id % {len(answers)} {cases} END"
    return f"SELECT CAST(page_id AS VARCHAR) AS page_id, replace({body}, '{{p}}', CAST(page_id AS VARCHAR)) AS marks FROM pages"


def rule(name: str, fragments: list[str], answers: list[str], apply, value=None):
    """Register one cleaning rule with its fragments and what must remain of them."""

    @query(name, expected(*answers))
    def run(spark, sf):
        pages = illustrated(spark, sf, fragments)
        return marks(apply(parse_nodes(pages), pages), value() if value else None)

    return run


@query("ext_01_parse_elements", """
SELECT CAST(page_id AS VARCHAR) AS page_id, len(regexp_extract_all(html, '<p>')) AS n_p, len(regexp_extract_all(html, '<a ')) AS n_a,
  len(regexp_extract_all(html, '<li>')) AS n_li, len(regexp_extract_all(html, '<b>')) AS n_b, len(regexp_extract_all(html, '<br>')) AS n_br FROM pages""")
def parse_elements(spark, sf):
    n = parse_nodes(D.pages(spark, sf))
    return n.groupBy("page_id").agg(*[F.count_if(node_tag() == t).alias(f"n_{t}") for t in ("p", "a", "li", "b", "br")])


rule("ext_02_remove_tags",
     ['<script id="x1">1</script><p id="x2">a</p><form id="x3"><input id="x4"></form><nav id="x5">n</nav><div id="x6" class="my-newsletter-box">z</div>',
      '<div id="x1" role="tooltip">t</div><div id="x2" class="a comments"><p id="x3">c</p></div><svg id="x4"></svg><span id="x5" data-nosnippet>s</span><p id="x6">keep</p>',
      '<img id="x1" src="/placeholder/a.png"><iframe id="x2"></iframe><button id="x3">b</button><div role="navigation" id="x4"><a id="x5" href="/">h</a></div><em id="x6">e</em>'],
     ["x2", "x6", "x6"], lambda n, p: R.remove_tags(n))
rule("ext_02_remove_tags_full",
     ['<iframe id="x1"></iframe><aside id="x2">a</aside><style id="x3">s</style>',
      '<video id="x1"></video><select id="x2"><option id="x3">o</option></select><h2 id="x4">h</h2>'],
     ["x1 x2 x3", "x4"], lambda n, p: R.remove_tags(n, "full"))
rule("ext_03_unwrap_landmarks",
     ['<header id="x1"><h2 id="x2">t</h2></header><footer id="x3"><i id="x4">f</i></footer>',
      '<aside id="x1"><figure id="x2"><img id="x3" src="a.jpg"><figcaption id="x4">c</figcaption></figure></aside><aside id="x5"><p id="x6">r</p></aside>'],
     ["x2 x4", "x2 x3 x4"], lambda n, p: R.unwrap_landmarks(n))
rule("ext_03_unwrap_custom",
     ['<my-slot id="x1"><p id="x2">a</p></my-slot><figure id="x3"><img id="x4" src="a.jpg"></figure>'],
     ["x2 x4"], lambda n, p: R.unwrap_custom(n))
rule("ext_04_strip_non_content_images",
     ['<img id="x1" src="/a{p}.jpg" width="20" height="300"><img id="x2" src="/b.jpg" width="300" height="300">',
      '<img id="x1" src="https://pixel.example.com/{p}"><img id="x2" src="https://e.example.com/track/{p}.gif"><img id="x3" src="/c.jpg" height="30"><img id="x4" src="/d.jpg" width="50%">'],
     ["x2", "x4"], lambda n, p: R.strip_non_content_images(n))
rule("ext_05_constrain_avatars",
     ['<img id="x1" alt="User Avatar" width="400" height="380" src="a"><img id="x2" alt="avatar" width="400" height="200" src="b"><img id="x3" alt="photo" width="50" height="50" src="c">'],
     ["x1=100 x2=400 x3=50"], lambda n, p: R.constrain_avatars(n), lambda: attr("width"))
rule("ext_06_strip_byline_images",
     ['<img id="x1" alt="Ann\'s avatar" src="/a.jpg"><img id="x2" alt="Avatar the movie" src="/b.jpg">',
      '<img id="x1" alt="Headshot of B" width="90" height="100" src="/c.jpg"><img id="x2" alt="photo of lake" width="900" height="600" src="/d.jpg"><img id="x3" src="https://cdn-avatars.example.com/u{p}.jpg">'],
     ["x2", "x2"], lambda n, p: R.strip_byline_images(n))
_CARD = '<div id="x1"><a id="x2" href="/other/{p}"><img id="x3" src="/t.jpg" width="100" height="80"></a><h3 id="x4"><a id="x5" href="/other/{p}">Story</a></h3></div>'

def _keep_all(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages that lost every mark still show an empty list."""
    blank = pages.select(
        F.col("page_id").cast("string").alias("page_id"), F.lit(-2).alias("pre"), F.lit(-2).alias("last"),
        F.lit(-1).alias("parent"), F.array().cast("array<int>").alias("path"), F.lit("meta").alias("tag"),
        F.create_map(F.lit("id"), F.lit("x")).alias("attrs"), F.lit(None).cast("string").alias("text"))
    return nodes.select(*dom.NODE_COLUMNS).unionByName(blank)


_CARDS = [
    _CARD, f'<div id="x0"><div id="x7">{_CARD}</div><p id="x8">text</p></div>',
    '<div id="x1"><a id="x2" href="/other"><img id="x3" src="/t.jpg" width="900" height="800"></a><h3 id="x4"><a id="x5" href="/other">Story</a></h3></div>',
]


# The rule leaves nothing of some pages, so the answers start with a blank mark.
@query("ext_07_strip_thumbnail_cards", expected("x", "x x0 x7 x8", "x x1 x2 x3 x4 x5"))
def strip_thumbnail_cards(spark, sf):
    pages = illustrated(spark, sf, _CARDS)
    n = parse_nodes(pages).join(J._page(pages), "page_id")
    n = R.strip_thumbnail_cards(n, F.lower(urls.path(F.col("page_url")))).drop("page_url")
    return marks(_keep_all(n, pages))


rule("ext_08_strip_badge_clusters",
     ['<p id="x1"><a href="/a"><img id="x2" src="b1.svg"></a> <img id="x3" src="b2.svg"></p><p id="x4"><img id="x5" src="c.jpg"></p>',
      '<p id="x1"><img id="x2" src="a.jpg"><img id="x3" src="b.jpg"> words</p><p id="x4"><a href="/a"><img id="x5" src="b1.svg">t</a><img id="x6" src="b"></p>'],
     ["x4 x5", "x1 x2 x3 x4 x5 x6"], lambda n, p: R.strip_badge_clusters(n))
rule("ext_09_drop_aria_hidden",
     ['<p id="x1" aria-hidden="true">a</p><div id="x2" aria-hidden="true"><b id="x3">b</b></div><h2 id="x4" aria-hidden="true">h</h2>'],
     ["x1 x4"], lambda n, p: R.drop_aria_hidden_content(n, full=True))
rule("ext_10_strip_interstitials",
     ['<p id="x1"> Article continues below </p><span id="x2">Loading...</span><div id="x3">Loading the dishwasher</div>',
      '<div id="x1">Story continues below<p id="x2">inner</p></div><em id="x3">loading...</em>'],
     ["x3", "x3"], lambda n, p: R.strip_interstitials(n))
rule("ext_11_strip_empty",
     ['<ul id="x1"><li id="x2"> </li><li id="x3"><span id="x4"></span></li></ul><div id="x5"><img id="x6" src="a"></div>',
      '<section id="x1"><div id="x2"><p id="x3">t</p><p id="x4">\n</p></div></section><table id="x5"><tr id="x6"><td id="x7"></td></tr></table>'],
     ["x5 x6", "x1 x2 x3 x5 x6 x7"], lambda n, p: R.strip_empty(n))
rule("ext_12_strip_sticky",
     ['<div id="x1" style="position: sticky; top:0">a</div><div id="x2" style="position:relative">b</div><div id="x3" style="position:fixed">c</div>'],
     ["x1=position:static; top:0 x2=position:relative x3=position:static"], lambda n, p: R.strip_sticky(n), lambda: attr("style"))
rule("ext_13_strip_image_styles",
     ['<img id="x1" style="width:100%" class="c" loading="lazy" data-nimg="1" src="/a{p}.jpg" alt="t">'],
     ["x1=alt,id,src"], lambda n, p: R.strip_image_styles(n), lambda: F.array_join(F.array_sort(F.map_keys("attrs")), ","))
rule("ext_14_promote_noscript_images",
     ['<noscript id="x1"><img id="x2" src="/real{p}.jpg"></noscript><img id="x3" src="data:x">',
      '<img id="x1"><noscript id="x2"><img id="x3" src="/real{p}.jpg"></noscript><p id="x4" src="-">t</p>',
      '<p id="x1" src="-">t</p><noscript id="x2"><a id="x3"><img id="x4" src="/real{p}.jpg"></a></noscript>'],
     ["x3=/real{p}.jpg", "x1=/real{p}.jpg x4=-", "x1=- x4=/real{p}.jpg"], lambda n, p: R.promote_noscript_images(n), lambda: attr("src"))
rule("ext_15_recover_placeholder_images",
     ['<img id="x1" src="data:a" data-src="/low.jpg" data-lazy-src="/hi{p}.jpg"><img id="x2" src="/ok.jpg" data-src="/no.jpg">',
      '<img id="x1" data-runner-src="https://e.example.com/{p}.jpg"><img id="x2" data-srcs=\'{"https://j.example.com/{p}.jpg":{"contentType":"image/jpeg"}}\'>',
      '<a href="/zoom/{p}.png"><img id="x1" src="data:a"></a><a href="/page"><img id="x2" src="data:b"></a><img id="x3" src="/spacer.gif" data-original="/o{p}.jpg">'],
     ["x1=/hi{p}.jpg x2=/ok.jpg", "x1=https://e.example.com/{p}.jpg x2=https://j.example.com/{p}.jpg", "x1=/zoom/{p}.png x2=data:b x3=/o{p}.jpg"],
     lambda n, p: R.recover_placeholder_images(n), lambda: attr("src"))
rule("ext_16_unwrap_picture",
     ['<picture id="x1"><source id="x2" srcset="/s{p}.jpg 1x, /t.jpg 2x"><img id="x3" src="data:z"></picture>',
      '<picture id="x1"><source id="x2" srcset="/s.jpg"><img id="x3" src="/own{p}.jpg"></picture>'],
     ["x3=/s{p}.jpg", "x3=/own{p}.jpg"], lambda n, p: R.unwrap_picture(n), lambda: attr("src"))
rule("ext_17_strip_caption_toggles",
     ['<b id="x1">Hide caption</b><b id="x2">bold</b><i id="x3">toggle caption</i>'],
     ["x2 x3"], lambda n, p: R.strip_caption_toggles(n))
rule("ext_19_flatten_image_divs",
     ['<div id="x1"><div id="x2"><img id="x3" src="a"><img id="x4" src="b"></div></div><div id="x5">t<img id="x6" src="c"></div>'],
     ["x3 x4 x5 x6"], lambda n, p: R.flatten_image_divs(n))
rule("ext_19_flatten_single_child_divs",
     ['<div id="x1"><div id="x2"><div id="x3"><p id="x4">t</p><p id="x5">u</p></div></div></div><div id="x6"><p id="x7">v</p></div>'],
     ["x3 x4 x5 x6 x7"], lambda n, p: R.flatten_single_child_divs(n))
rule("ext_20_wrap_standalone_images",
     ['<hr><img id="x1" src="a"><p id="x2"><img id="x3" src="b"></p><div id="x4"><img id="x5" src="c"></div>'],
     ["x1=true x2=false x3=false x4=false x5=true"], lambda n, p: R.wrap_standalone_images(n), lambda: F.col("wrap").cast("string"))
rule("ext_21_strip_banner_images",
     ['<img id="x1" width="900" height="100" src="a"><img id="x2" width="400" height="100" src="b"><img id="x3" width="160" height="20" src="c">'],
     ["x2 x3"], lambda n, p: R.strip_banner_images(n))
rule("ext_22_strip_promo_links",
     ['<a id="x1" href="/promo/{p}"><img id="x2" src="a"></a><a id="x3" href="/zoom.jpg"><img id="x4" src="b"></a><a id="x5" href="#"><img id="x6" src="c"></a>',
      '<a id="x1" href="https://shop.example.com/"><img id="x2" src="a"></a><a id="x3" href="/q">t<img id="x4" src="b"></a><a id="x5" href="/"><img id="x6" src="c"></a>'],
     ["x3 x4 x5 x6", "x3 x4 x5 x6"],
     lambda n, p: R.strip_promo_links(J._with_link_base(n, p), F.col("page_url")).drop("page_url"))


# ---- page facts


@query("ext_18_og_image", """
SELECT CAST(page_id AS VARCHAR) AS page_id, 'https://' || regexp_extract(url, '://([^/?#]*)', 1) || CASE WHEN page_id % 2 = 0 THEN '/og' ELSE '/tw' END || page_id || '.jpg' AS og_image FROM pages""")
def og_image(spark, sf):
    pages = illustrated(spark, sf, [
        '<meta name="twitter:image" content="/tw{p}.jpg"><meta property="og:image" content="/og{p}.jpg">',
        '<meta property="og:image" content=""><meta name="twitter:image" content="/tw{p}.jpg">'])
    return E.og_image(parse_nodes(pages), J._page(pages))


@query("fn_27_fallback_title", r"""
SELECT CAST(page_id AS VARCHAR) AS page_id, trim(split_part(regexp_replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&'), '[\s\x{A0}]+', ' ', 'g'), ' | ', 1)) AS title FROM pages""")
def fallback_title(spark, sf):
    pages = D.pages(spark, sf).withColumn("html", F.replace("html", F.lit("</title>"), F.lit(" | Site name</title>")))
    return E.fallback_title(parse_nodes(pages))


_LINKS = ['<link rel="apple-touch-icon" sizes="60x60" href="/t60.png"><link rel="apple-touch-icon" sizes="180x180" href="/t{p}.png"><link rel="icon" sizes="512x512" href="/i.png">',
          '<link rel="apple-touch-icon" sizes="any" href="/t.svg"><link rel="shortcut icon" href="/s{p}.ico"><link rel="icon" sizes="16x16" href="/i{p}.png">', '<link rel="icon" href="/v.svg">']


@query("win_15_pick_favicon", """
SELECT CAST(page_id AS VARCHAR) AS page_id, regexp_extract(url, '^(https?)', 1) || '://' || regexp_extract(url, '://([^/?#]*)', 1) ||
  CASE page_id % 3 WHEN 0 THEN '/t' || page_id || '.png' WHEN 1 THEN '/i' || page_id || '.png' ELSE '/favicon.ico' END AS icon_url FROM pages""")
def pick_favicon(spark, sf):
    pages = illustrated(spark, sf, _LINKS)
    return E.pick_favicon(parse_nodes(pages), J._page(pages))


@query("ext_35_discover_feed_links", """
SELECT CAST(page_id AS VARCHAR) AS page_id, CASE page_id % 3 WHEN 0 THEN 'https://' || regexp_extract(url, '://([^/?#]*)', 1) || '/rss' || page_id ELSE 'https://f.example.com/' || page_id END AS feed_url
FROM pages WHERE page_id % 3 <> 2""")
def discover_feed_links(spark, sf):
    pages = illustrated(spark, sf, [
        '<link rel="alternate" type="text/html" href="/x"><link rel="alternate" type="application/rss+xml" href="/rss{p}"><link rel="alternate" type="application/atom+xml" href="/atom">',
        '<link rel="alternate" type="Application/Atom+XML" href="http://f.example.com/{p}">', '<link rel="alternate" hreflang="fr" href="/fr">'])
    return E.discover_feed_links(parse_nodes(pages), J._page(pages))


@query("ext_38_content_images", """
SELECT CAST(page_id AS VARCHAR) AS page_id, '/a' || page_id || '.jpg /b.jpg' AS image_urls FROM pages""")
def content_images(spark, sf):
    pages = illustrated(spark, sf, ['<img src="/a{p}.jpg"><img><img data-src="/b.jpg">'])
    return E.content_images(parse_nodes(pages)).select("page_id", F.array_join("image_urls", " ").alias("image_urls"))


@query("agg_11_image_count", "SELECT CAST(page_id AS VARCHAR) AS page_id, page_id % 3 AS image_count FROM pages")
def image_count(spark, sf):
    pages = illustrated(spark, sf, ["", '<img src="a">', '<img src="a"><p><img></p>'])
    return E.image_count(parse_nodes(pages))


@query("ext_23_next_data_article", """
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '<p>' || repeat('Story ' || page_id || ' goes on. ', 20) || '</p>' END AS embedded_html FROM pages""")
def next_data_article(spark, sf):
    story = "concat('<p>', repeat(concat('Story ', page_id, ' goes on. '), 20), '</p>')"
    js = f"concat('<script id=\"__NEXT_DATA__\" type=\"application/json\">', to_json(named_struct('props', named_struct('t', 'x\"y', 'list', array(named_struct('body', {story}))))), '</script>')"
    extra = F.expr(f"CASE page_id % 3 WHEN 0 THEN {js} WHEN 1 THEN concat({story}, {js}) ELSE '<script id=\"__NEXT_DATA__\">broken {{</script>' END")
    pages = D.pages(spark, sf).withColumn("html", F.replace("html", F.lit("</article>"), F.concat(extra, F.lit("</article>"))))
    return embedded.with_embedded_article(pages).select("page_id", "embedded_html")


_APOLLO = ('<script>window.__APOLLO_STATE__ = {"ROOT_QUERY":{"__typename":"Query","article({})":{"__typename":"Article","segments({})":['
           '{"type":"TEXT","image({})":{"__ref":"Image:1"}},{"type":"CALL_TO_ACTION","image":{"__ref":"Image:9"}},'
           '{"type":"GALLERY","gallery":{"__ref":"Gallery:1"}}]}},"Image:1":{"uri":"/one{p}.jpg"},"Image:9":{"url":"/cta.jpg"},'
           '"Image:2":{"url":"/two{p}.jpg"},"Gallery:1":{"galleryitems({})":{"nodes":[{"image":{"__ref":"Image:2"}}]}}};</script>')


@query("ext_24_apollo_images", expected("x1=/one{p}.jpg x2= x3=/two{p}.jpg x4=", "x1= x2="))
def apollo_images(spark, sf):
    pages = illustrated(spark, sf, [
        _APOLLO + '<span id="x1" style="padding-top: 74.5%"></span><div id="x2" style="padding-top:50%"><b>full</b></div><div id="x3" style="padding-top:50%"> </div><i id="x4" style="padding-top:20%"></i>',
        '<span id="x1" style="padding-top: 74.5%"></span><p id="x2">t</p>'])
    boxes = parse_nodes(pages)
    filled = embedded.fill_placeholders(boxes, embedded.apollo_images(pages))
    # A filled box becomes the image itself; its id is read from the same node number.
    ids = boxes.filter(attr("id").startswith("x")).select("page_id", "pre", attr("id").alias("mark"))
    named = ids.join(filled.select("page_id", "pre", "attrs"), ["page_id", "pre"], "left").withColumn(
        "attrs", F.map_concat(F.create_map(F.lit("id"), F.col("mark")), F.create_map(F.lit("src"), attr("src"))))
    return marks(named, attr("src"))


# ---- body, hero and images


@query("ext_25_main_block", "SELECT CAST(page_id AS VARCHAR) AS page_id, 'article' AS root_tag FROM pages")
def main_block(spark, sf):
    nodes = dom.prune(parse_nodes(D.pages(spark, sf)), R.removed_by_tag("signal"))
    return E.main_block(nodes).select("page_id", "root_tag")


_HERO = [
    '<img id="x1" src="/logo.png" width="600" height="400"><img id="x2" src="/h{p}.jpg" width="800" height="500">',
    '<img id="x1" src="/small.jpg" width="100" height="100"><img id="x2" src="/avatar/a.jpg"><a href="/other"><img id="x3" src="/promo.jpg"></a><meta property="og:image" content="/og{p}.jpg">',
    '<span class="site-logo"><img id="x1" src="/mark.jpg"></span><span class="logo"><img id="x2" src="/brand.jpg"></span><a href="/z{p}.jpg"><img id="x3" src="/z{p}.jpg"></a>',
]


@query("ext_26_hero_candidates", """
SELECT CAST(page_id AS VARCHAR) AS page_id, m.src, m.ok AS acceptable FROM pages, (VALUES
  (0, '/logo.png', false), (0, '/h{p}.jpg', true), (1, '/small.jpg', false), (1, '/avatar/a.jpg', false), (1, '/promo.jpg', false),
  (2, '/mark.jpg', true), (2, '/brand.jpg', false), (2, '/z{p}.jpg', true)) m(k, src, ok) WHERE page_id % 3 = m.k""".replace("m.src,", "replace(m.src, '{p}', CAST(page_id AS VARCHAR)) AS src,"))
def hero_candidates(spark, sf):
    pages = illustrated(spark, sf, _HERO)
    return E.hero_candidates(parse_nodes(pages), J._page(pages)).select("page_id", "src", "acceptable")


@query("win_13_pick_hero", """
SELECT CAST(page_id AS VARCHAR) AS page_id, CASE page_id % 3 WHEN 0 THEN '/h' || page_id || '.jpg' WHEN 1 THEN 'https://' || regexp_extract(url, '://([^/?#]*)', 1) || '/og' || page_id || '.jpg' ELSE '/mark.jpg' END AS hero_image_url,
  page_id % 3 <> 1 AS scoped FROM pages""")
def pick_hero(spark, sf):
    pages = illustrated(spark, sf, _HERO)
    nodes, page = materialize(parse_nodes(pages)), J._page(pages)
    hero = E.pick_hero(E.hero_candidates(nodes, page), page, E.og_image(nodes, page))
    return hero.select("page_id", "hero_image_url", "scoped")


@query("ext_27_inject_hero", """
SELECT CAST(page_id AS VARCHAR) AS page_id, CASE page_id % 3 WHEN 0 THEN '/h' || page_id || '.jpg' WHEN 1 THEN 'https://' || regexp_extract(url, '://([^/?#]*)', 1) || '/og' || page_id || '.jpg' ELSE '/mark.jpg' END AS hero_image_url,
  CASE page_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'https://' || regexp_extract(url, '://([^/?#]*)', 1) || '/og' || page_id || '.jpg' ELSE '/mark.jpg' END AS injected FROM pages""")
def inject_hero(spark, sf):
    pages = illustrated(spark, sf, _HERO)
    nodes, page = materialize(parse_nodes(pages)), J._page(pages)
    hero = E.pick_hero(E.hero_candidates(nodes, page), page, E.og_image(nodes, page))
    # The content keeps only the images that have a declared size.
    content = dom.render(nodes.filter((node_tag() != "img") | dom.has_attr("width")).filter(node_tag() != "meta"))
    return E.inject_hero(hero, content).select("page_id", "hero_image_url", F.try_element_at("hero_attrs", F.lit("src")).alias("injected"))


_DUPS = "https://c.example.com"


def _images(spark, sf) -> DataFrame:
    """Five image addresses per page, some of them variants of each other."""
    refs = F.posexplode(F.array(
        F.lit(_DUPS + "/h/x/pic.jpg?w=1"), F.lit(_DUPS + "/h/x/pic.jpg?w=2"), F.lit(_DUPS + "/k/x/pic.jpg"),
        F.expr(f"concat('{_DUPS}/m?id=', page_id % 2)"), F.expr(f"concat('{_DUPS}/m?id=', page_id % 3)"), F.lit(_DUPS + "/a/image.jpg"),
        F.lit(_DUPS + "/b/image.jpg"), F.lit("/rel/pic.jpg"), F.lit("/rel/pic.jpg"), F.lit("data:x"), F.lit("data:x"),
    )).alias("pre", "src")
    return D.pages(spark, sf).select("page_id", refs)


@query("win_11_dedup_images", """
SELECT page_id, pre, pre IN (1, 2, 4, 8) AS duplicate FROM pages, range(0, 11) r(pre)""")
def dedup_images(spark, sf):
    return E.duplicate_images(_images(spark, sf)).select("page_id", big("pre"), "duplicate")


@query("win_12_dedup_sibling_images", """
SELECT page_id, pre, CASE WHEN page_id % 2 = 0 THEN pre IN (0) ELSE pre = 1 END AS sibling_duplicate FROM pages, range(0, 3) r(pre)""")
def dedup_sibling_images(spark, sf):
    img = D.pages(spark, sf).select("page_id", F.posexplode(F.array(
        F.lit("/i-640x426.jpg"), F.lit("/i-1024x648.jpg"), F.lit("/i-300x200.jpg"))).alias("pre", "src"))
    # The third variant sits under another parent; widths swap on odd pages.
    img = img.withColumn("parent", F.expr("CASE WHEN pre = 2 THEN 2 ELSE 1 END")).withColumn(
        "width", F.expr("CASE WHEN pre = 0 THEN 640 + (page_id % 2) * 1000 WHEN pre = 1 THEN 1024 END"))
    return E.sibling_duplicates(img).select("page_id", big("pre"), "sibling_duplicate")


@query("join_16_ancestors", """
SELECT CAST(page_id AS VARCHAR) AS page_id, lvl AS level, cls AS class FROM pages, (VALUES (1, 'inner'), (2, 'outer')) v(lvl, cls)""")
def ancestors(spark, sf):
    pages = illustrated(spark, sf, ['<div class="far"><div class="outer"><span class="inner"><img src="a"></span></div></div>'])
    return dom.ancestors(parse_nodes(pages), node_tag() == "img", 2, {"class": attr("class")}).select("page_id", big("level"), "class")


@query("join_17_recover_dropped_images", """
SELECT CAST(page_id AS VARCHAR) AS page_id, '/lost' || page_id || '.jpg' AS src FROM pages""")
def recover_dropped_images(spark, sf):
    pages = illustrated(spark, sf, [
        '<p><a><img src="/lost{p}.jpg"></a></p><p>short</p><p>A paragraph that number {p} can be found by.</p><p><img src="/kept.jpg"></p>'])
    nodes = materialize(parse_nodes(pages))  # read several times
    # The content lost the image-only paragraph but kept everything else.
    content = nodes.filter(~((node_tag() == "img") & attr("src").startswith("/lost")))
    return E.recover_dropped_images(nodes, content).select("page_id", "src")


@query("win_16_excerpt", r"""
, p AS (SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(13)) AS t FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
a AS (SELECT *, length(t) AS n FROM p WHERE t <> ''),
b AS (SELECT *, max(CASE WHEN n >= 20 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS opened FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM b WHERE opened = 1),
d AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM c WHERE k <= 5),
e AS (SELECT *, used + n > 1500 AND k > 1 AS over_ FROM d),
f AS (SELECT *, coalesce(max(CASE WHEN over_ THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS past FROM e),
g AS (SELECT *, CAST(1500 - used AS BIGINT) AS rest, substr(t, 1, CAST(1500 - used AS BIGINT)) AS cut FROM f WHERE past = 0),
h AS (SELECT doc_id, k, CASE WHEN NOT over_ THEN t WHEN rest <= 50 THEN '' WHEN contains(cut, '.') THEN regexp_extract(cut, '(?s)^(.*[.])', 1)
  WHEN contains(cut, ' ') THEN regexp_extract(cut, '(?s)^(.* )', 1) || '…' ELSE '' END AS part FROM g)
SELECT doc_id, string_agg(part, chr(10) || chr(10) ORDER BY k) AS excerpt FROM h WHERE part <> '' GROUP BY doc_id""")
def excerpt(spark, sf):
    para = D.documents(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return E.excerpt(para, "doc_id")


# ---- jobs


@query("ext_33_clean_feed_html", r"""
SELECT CAST(doc_id AS VARCHAR) AS page_id, greatest(0, length(trim(regexp_replace(text, '[\s\x{A0}]+', ' ', 'g')))) >= 50 AS ok, doc_id % 2 AS image_count,
  CASE WHEN doc_id % 2 = 1 THEN '/f' || doc_id || '.jpg' END AS hero_image_url FROM documents""")
def clean_feed_html(spark, sf):
    html = F.expr("concat('<script>x</script>', CASE WHEN doc_id % 2 = 1 THEN concat('<img src=\"/f', doc_id, '.jpg\">') ELSE '' END, text, '<form>f</form>')")
    items = D.documents(spark, sf).select(F.col("doc_id").alias("page_id"), html.alias("html"))
    return J.clean_feed_html(items).select("page_id", "ok", big("image_count"), "hero_image_url")


@query("ext_34_extract_standard", """
SELECT CAST(page_id AS VARCHAR) AS page_id, trim(split_part(regexp_replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&'), '\\s+', ' ', 'g'), ' | ', 1)) AS title,
  length(regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<[^>]*>', ' ', 'g')) >= 50 AS long_enough FROM pages""")
def extract_standard(spark, sf):
    out = J.extract_standard(D.pages(spark, sf))
    return out.select("page_id", "title", F.col("ok").alias("long_enough"))


@query("ext_34_extract_illustrated")
def extract_illustrated(spark, sf):
    return J.extract_standard(illustrated(spark, sf, _HERO)).select(
        "page_id", "title", "image_count", "hero_image_url", "word_count", "text_chars", "ok")


@query("ext_34_extract_full")
def extract_full(spark, sf):
    return J.extract_full(D.pages(spark, sf)).select(
        "page_id", "image_count", "hero_image_url", "word_count", "text_chars", "ok")


@query("ext_36_page_signals", r"""
SELECT CAST(page_id AS VARCHAR) AS page_id, len(regexp_extract_all(regexp_replace(regexp_replace(replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '&amp;', '&'), '</?(p|h1|br)>', ' ', 'g'), '<[^>]*>', '', 'g'), '\S+')) AS word_count,
  0 AS image_count, 0 AS paywall_score FROM pages""")
def page_signals(spark, sf):
    return J.page_signals(D.pages(spark, sf)).select("page_id", big("word_count"), big("image_count"), big("paywall_score"))


@query("flt_07_needs_rss_fallback", r"""
, w AS (SELECT page_id, len(regexp_extract_all(regexp_replace(regexp_replace(replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '&amp;', '&'), '</?(p|h1|br)>', ' ', 'g'), '<[^>]*>', '', 'g'), '\S+')) AS n FROM pages)
SELECT CAST(page_id AS VARCHAR) AS page_id, CASE WHEN n >= 50 THEN 'page' WHEN page_id % 2 = 0 THEN 'feed' ELSE 'none' END AS content_from FROM w""")
def needs_rss_fallback(spark, sf):
    pages = D.pages(spark, sf)
    extract = J.page_signals(pages).withColumn("ok", F.lit(True))
    feed = pages.select(F.col("page_id").cast("string").alias("page_id"), F.expr("CASE WHEN page_id % 2 = 0 THEN 'c' ELSE '' END").alias("rss_content_html"))
    return J.needs_feed_fallback(extract, feed).select("page_id", "content_from")
