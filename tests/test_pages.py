import gc
import random
from pathlib import Path

from pyspark.sql import functions as F

from feedloom.operators import dom, extract as E
from feedloom.operators.page_store import LEAST_BYTES, PageStore, bucket_count
from feedloom.plans import extract_job as J
from feedloom.session import shared_dir, with_settings
from feedloom.sources.html import parse_nodes

BODY = " ".join(f"Sentence number {i}, with some more words in it." for i in range(40))
PAGE = f"""<html><head><title>Good title | Site</title><meta property="og:image" content="/og.jpg"></head><body>
<header>Site header</header><nav><a href="/">Home</a></nav>
<main><img src="/hero.jpg" width="1200" height="700"><article><header><h1>Good title</h1></header>
<p>{BODY}</p><div class="c"><div><img src="/inline-640x426.jpg" width="640"><img src="/inline-1024x648.jpg" width="1024"></div></div>
<p>Another paragraph, a little shorter, closes the story for good.</p>
<p><a href="/b1"><img src="/badge1.svg"></a><a href="/b2"><img src="/badge2.svg"></a></p>
<script>var x = "<p>no</p>"</script><p>Article continues below</p><img src="/t.gif" width="1" height="1">
<noscript><img src="/real.jpg"></noscript><img src="data:x"></article></main>
<aside>Related</aside><footer>Foot</footer></body></html>"""


def pages(spark, *htmls):
    return spark.createDataFrame([(str(i), "https://site.example.com/story", h) for i, h in enumerate(htmls)],
                                 "page_id string, page_url string, html string")


def test_standard_extract(spark):
    short = "<html><body><p>Too little.</p></body></html>"
    rows = {r.page_id: r for r in J.extract_standard(pages(spark, PAGE, short)).collect()}
    r = rows["0"]
    assert r.ok and r.title == "Good title" and r.word_count > 300
    html = r.content_html
    assert "Sentence number 39" in html and "closes the story" in html
    for gone in ("Site header", "Related", "Foot", "<script", "badge1", "continues below", "t.gif", "<nav"):
        assert gone not in html
    assert r.hero_image_url == "/hero.jpg" and html.startswith('<img')
    assert "/inline-1024x648.jpg" in html and "/inline-640x426.jpg" not in html and "/real.jpg" in html
    assert r.image_count == 3
    assert not rows["1"].ok and rows["1"].content_html is None


def test_full_extract_keeps_the_page(spark):
    r = J.extract_full(pages(spark, PAGE)).first()
    assert r.ok and "<aside>Related</aside>" in r.content_html and "Site header" not in r.content_html
    assert r.hero_image_url == "/inline-1024x648.jpg" or r.hero_image_url.startswith("/")


def test_feed_content_gets_paragraphs(spark):
    flat = "One sentence here that is long. Two sentences are here too. Three make a paragraph. Four starts the next."
    r = J.clean_feed_html(spark.createDataFrame([("1", flat)], "page_id string, html string")).first()
    assert r.content_html.count("<p>") == 2 and r.ok


def test_tree_encoding(spark):
    nodes = parse_nodes(pages(spark, "<div><p>a<p>b<b>c</b></div><ul><li>x<li>y</ul>"))
    rows = {(r.tag, r.pre): r for r in nodes.collect()}
    assert [k[0] for k in sorted(rows, key=lambda k: k[1])] == ["div", "p", "#text", "p", "#text", "b", "#text", "ul", "li", "#text", "li", "#text"]
    assert rows["div", 0].last == 6 and rows["p", 3].path == [0] and rows["li", 10].parent == 7
    assert dom.render(nodes).first().html == "<div><p>a</p><p>b<b>c</b></p></div><ul><li>x</li><li>y</li></ul>"


def test_excerpt_cuts(spark):
    rows = [("1", 0, "By A"), ("1", 1, "x" * 30), ("1", 2, "y " * 600 + "End. Tail"), ("1", 3, "Sentence one. " + "z" * 400)]
    df = spark.createDataFrame(rows, "page_id string, pos int, text string")
    parts = E.excerpt(df).first().excerpt.split("\n\n")
    assert parts[0] == "x" * 30 and parts[1].endswith("Tail") and parts[2] == "Sentence one."


def test_padded_phrases_go_too(spark):
    from feedloom.operators import page_rules as R

    html = "<body><p>" + " " * 70 + "Loading..." + "\n" * 70 + "</p><p>Text.</p></body>"
    pages = spark.createDataFrame([("1", html)], "page_id string, html string")
    left = R.strip_interstitials(parse_nodes(pages)).filter("tag = '#text'").collect()
    assert [r.text.strip() for r in left if r.text.strip()] == ["Text."]


def test_images_outside_the_content_are_not_put_back(spark):
    from feedloom.operators import extract as E

    deep = "<span>" * 40 + '<img src="/deep.jpg">' + "</span>" * 40
    html = ("<body><div><p><img src='/side.jpg'></p><p>A paragraph of the sidebar that is long.</p></div>"
            f"<article><p>{deep}</p><p>A paragraph of the article that is long.</p></article></body>")
    nodes = parse_nodes(spark.createDataFrame([("1", html)], "page_id string, html string"))
    content = nodes.filter("tag <> 'img'")
    assert [r.src for r in E.recover_dropped_images(nodes, content).collect()] == ["/deep.jpg"]


def test_short_articles_are_found_by_their_element(spark):
    """No paragraph is long enough to score: what the page declares as its content is the body."""
    frame = '<body><div class="ad">{ad}</div>{body}<footer>&copy; the site and its partners</footer></body>'
    bodies = [
        "<article><h1>Short</h1><p>Short words.</article>", '<div role="main">Short words.</div>',
        "<article></article><main><p>Short words.</p></main>",
        "<article><p>One.</p></article><article><p>One, two, three.</p></article>", "<section>Short words.</section>",
    ]
    nodes = parse_nodes(pages(spark, *[frame.format(ad="An advert, not the story.", body=b) for b in bodies]))
    roots = {r.page_id: r for r in E.main_block(nodes).collect()}
    assert [roots[str(i)].root_tag for i in range(5)] == ["article", "div", "main", "article", "body"]
    second = [r.pre for r in nodes.filter("page_id = '3' AND tag = 'article'").orderBy("pre").collect()][1]
    assert roots["3"].root_pre == second
    words = {r.page_id: r.word_count for r in J.page_signals(pages(spark, frame.format(ad="An advert", body=bodies[0]))).collect()}
    assert words == {"0": 3}


def test_pages_are_parsed_once_for_all_readers(spark, sf):
    """The parser is no part of a plan that reads its nodes several times."""
    from feedloom.catalog import load_all

    for name in ("join_17_recover_dropped_images", "ext_27_inject_hero"):
        plan = load_all()[name].run(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan, name


def test_asset_list_goes_over_the_nodes_once(spark):
    from feedloom.operators import assets as A

    html = ('<p><img src="/a.jpg"></p><picture><source srcset="/b.webp 2x"><img src="/c.jpg"></picture>'
            '<div><source srcset="/no.webp"></div><link rel="stylesheet" href="/s.css">')
    nodes, page = parse_nodes(pages(spark, html)), J._page(pages(spark, html))
    want = {"standard": [("/a.jpg", "image"), ("/b.webp", "image"), ("/c.jpg", "image")],
            "full": [("/a.jpg", "image"), ("/c.jpg", "image"), ("/s.css", "stylesheet")]}
    for level, rows in want.items():
        found = A.asset_list(nodes, page, level)
        assert [(r.url, r.kind) for r in found.orderBy("pre").collect()] == [("https://site.example.com" + u, k) for u, k in rows]
        assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def _bytes_below(*paths):
    return sum(f.stat().st_size for p in paths for f in Path(p).rglob("*") if f.is_file())


def test_extraction_stores_few_bytes_a_page(spark, tmp_path):
    """What shuffles and stored steps leave on disk is bounded by the pages, compressed."""
    rng, words = random.Random(7), [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("ndo", "stil", "rev", "qua", "xim")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n)) + ", and so on."
    rows = [(i, f"https://e.example.com/{i}", f"<html><head><title>T {i}</title></head><body><div class='ad'>{text(9)}</div><article><h1>H {i}</h1>"
             + "".join(f"<p>{text(60)} <a href='/{i}'>{text(2)}</a></p>" for _ in range(12)) + f"<img src='/i{i}.jpg' width='600' height='400'></article></body></html>")
            for i in range(400)]
    given = str(tmp_path / "pages.parquet")
    spark.createDataFrame(rows, "page_id long, page_url string, html string").write.parquet(given)
    disks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    places = [str(d) for d in disks] + [shared_dir(spark).removeprefix("file:")]
    gc.collect()
    before = _bytes_below(*places)
    out = J.extract_standard(spark.read.parquet(given))
    assert out.count() == 400 and out.filter("ok AND image_count = 1").count() == 400
    assert _bytes_below(*places) - before < 4 * _bytes_below(given)


def test_stored_pages_keep_their_layout(spark):
    """Rules over a stored table neither shuffle nor sort it; joins deal out nothing."""
    html = "<body><div><p>One.</p><p>Two, three.</p></div></body>"
    given = pages(spark, *[html] * 9)
    with PageStore(given) as store:
        nodes = store.keep("nodes", parse_nodes(given, buckets=store.buckets))
        assert nodes.count() == 9 * 6
        some = nodes.filter("tag = 'p'")
        with with_settings(spark, {**store._settings, "spark.sql.autoBroadcastJoinThreshold": "-1"}):
            plan = dom.insert(dom.prune(nodes, F.col("tag") == "b"), some)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("Bucketed: true") == 2
        assert not [line for line in plan.splitlines() if "Sort [" in line and "pre#" in line]
        root = Path(store.root.removeprefix("file:"))
        assert (root / "nodes").exists()
        left = store.result(nodes.groupBy("page_id").count())
    assert not (root / "nodes").exists() and left.count() == 9


def test_parents_and_further_nodes_are_those_of_joins(spark):
    """Also for pages that come twice, where every match gives a row."""
    twice = pages(spark, "<div><p>a<b>b</b></p></div>", "<ul><li>x</ul>")
    nodes = parse_nodes(twice.unionByName(twice))
    up = nodes.filter("tag <> '#text'").select("page_id", F.col("pre").alias("parent"), F.col("tag").alias("up"))
    columns = ["page_id", "pre", "tag", "up"]
    rows = lambda d: sorted(map(str, d.select(columns).collect()))
    assert rows(dom.with_parent(nodes, {"up": F.col("tag")})) == rows(nodes.join(up, ["page_id", "parent"], "left"))
    extra = nodes.filter("page_id = '0' AND tag = 'b'").withColumn("pre", F.lit(-1))
    key = lambda d: sorted(map(str, d.select("page_id", "pre", "parent", "path", "tag", "attrs", "text").collect()))
    assert key(dom.insert(nodes, extra)) == key(nodes.unionByName(extra))


def test_an_images_own_paragraph_does_not_follow_it(spark):
    html = ("<body><article><p>A long paragraph that holds <img src='/in.jpg'> a picture.</p>"
            "<p>The paragraph after it is long, too.</p></article></body>")
    nodes = parse_nodes(pages(spark, html))
    found = E.recover_dropped_images(nodes, nodes.filter("tag <> 'img'")).collect()
    second = [r.pre for r in nodes.filter("tag = 'p'").orderBy("pre").collect()][1]
    assert [(r.src, r.before_pre) for r in found] == [("/in.jpg", second)]


def test_buckets_grow_with_the_input(spark):
    small, cores = spark.range(9), spark.sparkContext.defaultParallelism
    assert bucket_count(small) == cores
    large = spark.range(1 << 20)  # 8 MB
    assert bucket_count(large) >= 5
    with with_settings(spark, {"spark.sql.shuffle.partitions": "1000"}):
        assert bucket_count(small) == cores and bucket_count(large) == (8 << 20) // LEAST_BYTES
