import random
import re
import time
from html import unescape

import numpy as np
import pytest

from feedloom.llm import langid, line_blocks
from feedloom.llm.common import table

LONG = "<p>" + "Words of an article that goes on for a while. " * 4 + "</p>"
TEXT = ("Words of an article that goes on for a while. " * 4).strip()


@pytest.mark.parametrize("html,want", [
    ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>Hi", "Hi"), ("<script>" + "x" * 300, ""), ("<p> \n </p>", ""),
    (f"<nav><a href=x>Home</a></nav>{LONG}<p>Short.</p>{LONG}<footer>{LONG}</footer>", f"{TEXT}\n\nShort.\n\n{TEXT}"),
    (f"<ul><li><a href=a>One</a><li><a href=b>Two</a></ul>{LONG}<div id=comments>{LONG}</div>", TEXT),
    (f"<div class='cookie-notice'>{LONG}</div><article><header><h1>Title</h1></header>{LONG}<p>End.</article>{LONG}", f"Title\n\n{TEXT}\n\nEnd."),
    (f"<div>{LONG}<form>{LONG}</form><style>p>a{{}}</style><!-- <p>no</p> -->{LONG}</div>", f"{TEXT}\n\n{TEXT}"),
    ("<p>a<b>b</b>\n\t c&nbsp;d<br>e</p>", "ab c d\n\ne"),
])
def test_main_text(html, want):
    assert line_blocks.main_text(html) == want


@pytest.mark.parametrize("html,want", [
    *[(f"<div class='{c}'>{LONG}</div><p>{TEXT}", f"{TEXT}\n\n{TEXT}") for c in ("layout has-sidebar", "no-sidebar", "elementor-widget-container", "search-page")],
    (f"<div class='layout widget'><article>{LONG}</article><div class='ad'>{LONG}</div></div>", TEXT),
    (f"<div class='widget'>{LONG}{LONG}</div>{LONG}", f"{TEXT}\n\n{TEXT}\n\n{TEXT}"),
    (f"{LONG}<div class='comment-list'>{LONG}{LONG}</div>", TEXT),
    (f"<div><p class='ad'>Buy this.{LONG}<p class=notice>Note.<p>{TEXT}</div>", f"{TEXT}\n\n{TEXT}"),
    (f"<ul><li class=ad>Buy.<li>{TEXT}</ul>", TEXT),
    (f"<div><a name=x>{LONG}</div>{LONG}", f"{TEXT}\n\n{TEXT}"),
    (f"<p><a href=x>One <a href=y>Two</a> {TEXT}", f"One Two {TEXT}"),
])
def test_nothing_hides_the_text(html, want):
    assert line_blocks.main_text(html) == want


def test_article_tags_are_a_bonus(spark, sf):
    cards = "".join(f"<article><h2><a href=/{i}>Card {i}</a></h2><p>A few words of a teaser that leads elsewhere.</article>" for i in range(6))
    for page in (f"<div>{LONG}{LONG}{LONG}</div>{cards}", f"{cards}<div>{LONG}<p>Short.</p>{LONG}{LONG}</div>"):
        got = line_blocks.main_text(page)
        assert got.count(TEXT) == 3 and "Card" not in got
    assert line_blocks.main_text(f"<article>{LONG}</article><div>{LONG}{LONG}</div>").count(TEXT) == 3
    # Without the tags, most pages of the table give the same.
    pages = [r.html for r in table(spark, sf, "pages").collect()]
    same = [line_blocks.main_text(h) == line_blocks.main_text(re.sub(r"</?(?:article|main)\b[^>]*>", "", h)) for h in pages]
    assert sum(same) / len(same) > 0.9


def stripped(html, tags=False, words=False):
    if words:
        html = re.sub(r"""\s(?:class|id|role)=("[^"]*"|'[^']*'|[^\s>]*)""", "", html)
    if tags:
        html = re.sub(r"<(/?)(?:article|main|section|nav|header|footer|aside)\b[^>]*>", r"<\1div>", html)
    return html


def test_the_distribution_decides_without_any_hint(spark, sf):
    """Sections made plain containers, words of class and id gone: lines and their lengths are left."""
    pages = [r.html for r in table(spark, sf, "pages").collect()]
    for hints in ({"tags": True}, {"words": True}, {"tags": True, "words": True}):
        same = [line_blocks.main_text(h) == line_blocks.main_text(stripped(h, **hints)) for h in pages]
        assert sum(same) / len(same) > 0.9, hints
    body = f"<h1>A title that says something</h1>{LONG}<p>Short.</p>{LONG}<p>End.</p>"
    menu = "<ul>" + "".join(f"<li><a href=/{i}>Part {i}</a></li>" for i in range(9)) + "</ul>"
    notice, foot = "<p>We use things to improve your visit. OK?</p>", "<p>All rights reserved by the makers of this page, 2024.</p>"
    want = f"A title that says something\n\n{TEXT}\n\nShort.\n\n{TEXT}\n\nEnd."
    for page in (f"<div>{menu}</div><div>{notice}</div><div>{body}</div><div>{foot}</div>",
                 f"<table><tr><td><div>{menu}</div><div>{body}</div><div>{notice}</div><div>{foot}</div></table>",
                 f"<nav>{menu}</nav><div class=x1>{notice}</div><div class=x2>{body}</div><footer>{foot}</footer>"):
        assert line_blocks.main_text(page) == want
    parts = "".join(f"<div><p>{TEXT}</p></div><div><p>Between {i}.</p></div>" for i in range(4))
    assert line_blocks.main_text(f"<div>{menu}</div>{parts}<div><p>{TEXT}</p></div><div>{foot}</div>").count("Between") == 4


def test_a_tag_alone_does_not_decide():
    assert line_blocks.main_text(f"<div>{LONG}{LONG}</div><article><p>Related: a short card.</p></article>") == f"{TEXT}\n\n{TEXT}"
    assert line_blocks.main_text(f"<article><p>Hi.</p></article><div>{LONG}</div>") == TEXT
    # Links in an article are navigation all the same.
    linked = "".join(f"<p><a href=/{i}>Another story of this site, number {i}</a></p>" for i in range(4))
    assert line_blocks.main_text(f"<article>{LONG}{linked}</article>") == TEXT


@pytest.mark.parametrize("seed", range(5))
def test_stretches_by_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(60):
        weight = [rng.choice([0, 0, 1, 5, 20, 40, 70]) for _ in range(rng.randrange(0, 25))]
        window, surge = rng.randrange(1, 5), rng.choice([1, 30, 60])
        sums = [sum(weight[i:i + window]) for i in range(len(weight))]
        want = [any(sums[s] >= surge and weight[s] > 0 and all(x > 0 for x in sums[s + 1:i + 1]) for s in range(i + 1)) for i in range(len(weight))]
        assert line_blocks.stretches(np.array(weight, np.int64), window, surge).tolist() == want


ODD_MARKUP = {
    "open tag": lambda n: "<a " * n, "quotes": lambda n: "<a '" * n, "values": lambda n: '<a ="' * n, "end tag": lambda n: "</a" * n, "bang": lambda n: "<!" * n,
    "comment": lambda n: "<!--" * n, "mismatch": lambda n: "<i>" * n + "</b>" * n, "parts": lambda n: "<div class=ad>" * n, "links": lambda n: "<a href=x><b>" * n + "</a>" * n,
    "scope": lambda n: "<p><button>" + "<div>" * n, "items": lambda n: "<ul>" * n + "<li>" * n, "lines": lambda n: "<p>ab" * n, "less": lambda n: "< <" * n,
    "script": lambda n: "<script>" * n, "entities": lambda n: "&amp" * n, "divs": lambda n: "<div>x" * n + "</div>" * n, "space": lambda n: "<p" + " " * n + "class" + " " * n,
}


@pytest.mark.parametrize("name", ODD_MARKUP)
def test_time_is_proportional_to_length(name):
    def seconds(n):
        html, best = ODD_MARKUP[name](n), []
        for _ in range(2):
            start = time.process_time()
            line_blocks.main_text(html)
            best.append(time.process_time() - start)
        return min(best)

    seconds(1000)
    assert seconds(40_000) < max(0.5, 8 * seconds(10_000))


def test_surge_and_dive():
    weight = [0, 3, 0, 0, 90, 10, 0, 0, 80, 0, 0, 0, 0, 5]
    assert [i for i, k in enumerate(line_blocks.stretches(__import__("numpy").array(weight), 3, 60)) if k] == [4, 5, 6, 7, 8]


def test_pages_give_their_articles(spark, sf):
    rows = {r.page_id: r.html for r in table(spark, sf, "pages").collect()}
    got = line_blocks.extract(table(spark, sf, "pages")).collect()
    assert len(got) == len(rows)
    for r in got:
        inner = re.search(r"<article>(.*?)(</article>|<footer>)", rows[r.page_id], re.S).group(1)
        blocks = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1|br)\b[^>]*>", inner)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


ODD = [(1, "http://a.example.de/x", "<html lang=de><p>und der die das</p>"), (None, None, None), (2, "", ""), (2, "", ""),
       (3, "not a url", "<html lang='xx'>" + "the of and " * 20_000), (4, "http://www.b.example.fr:80/?q", None)]


def test_odd_pages(spark, sf):
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in ODD], "page_id long, url string, html string, text string, lang string")
    got = line_blocks.extract(pages).collect()
    assert sorted(str(r.page_id) for r in got) == sorted(str(r[0]) for r in ODD)
    assert all(r.text == "" and r.n_chars == 0 for r in got if r.page_id in (None, 2, 4))
    assert line_blocks.extract(pages.limit(0)).count() == 0
    docs = spark.createDataFrame([("the of and to", "en"), ("und der die das", "de"), ("le la les des", "fr"), (None, "fr"), ("x", None)], "text string, lang string")
    found = {r.page_id: r for r in langid.identify(pages, docs).collect()}
    assert len(found) == 5 and langid.identify(pages, docs).count() == len(ODD)
    assert found[1].lang == "de" and found[1].host == "a.example.de" and found[1].declared_lang == "de"
    assert found[3].lang == "en" and found[3].text_lang == "en" and found[3].host == ""
    assert found[4].host == "www.b.example.fr" and found[4].text_lang is None and found[4].lang is not None
    assert all(0 < r.probability <= 1 for r in found.values())
    assert langid.identify(pages.limit(0), docs).count() == 0
    assert {r.lang for r in langid.identify(pages, docs.limit(0)).collect()} == {None}


def test_languages_of_pages(spark, sf):
    pages = table(spark, sf, "pages")
    got = langid.identify(pages, table(spark, sf, "documents")).collect()
    assert len(got) == pages.count()
    assert sum(r.lang == r.declared_lang for r in got) / len(got) > 0.98
    # The text alone, with nothing declared and no address.
    bare = pages.selectExpr("page_id", "cast(null as string) as url", "regexp_replace(html, 'lang=', 'x=') as html")
    named = {r.page_id: r.declared_lang for r in got}
    found = langid.identify(bare, table(spark, sf, "documents")).collect()
    assert sum(r.lang == named[r.page_id] for r in found) / len(found) > 0.95


def test_host_prior_decides_where_the_text_says_nothing(spark):
    docs = spark.createDataFrame([("the of and to " * 5, "en"), ("und der die das " * 5, "de")], "text string, lang string")
    rows = [(i, "http://a.example.org/x", "<p>und der die das</p>") for i in range(20)] + [(50, "http://a.example.org/y", "<p></p>")]
    rows += [(100 + i, "http://b.other.com/x", "<p>the of and to</p>") for i in range(60)] + [(51, "http://b.other.com/y", "")]
    got = {r.page_id: r.lang for r in langid.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()}
    assert got[50] == "de" and got[51] == "en"


def test_languages_without_blanks(spark):
    docs = spark.createDataFrame([
        ("我们今天在北京的大学里学习中文。他们昨天在上海的公司里工作。", "zh"), ("私たちは今日東京の大学で日本語を勉強しています。彼らは昨日大阪の会社で働いていました。", "ja"),
        ("วันนี้เราเรียนภาษาไทยที่มหาวิทยาลัยในกรุงเทพ เมื่อวานนี้พวกเขาทำงานที่บริษัทในเชียงใหม่", "th"), ("the of and to " * 5, "en")],
        "text string, lang string")
    # Other clauses of the same languages, none of them a word, or a word's end, of the documents.
    pages = {1: ("zh", "明天我们在上海的大学里学习数学"), 2: ("ja", "明日私たちは大阪の大学で数学を勉強していますよ"),
             3: ("th", "พรุ่งนี้เราทำงานที่มหาวิทยาลัยในเชียงใหม่ครับ"), 4: ("en", "andof theto" * 3)}
    rows = spark.createDataFrame([(k, None, f"<p>{t}</p>") for k, (_, t) in pages.items()], "page_id long, url string, html string")
    got = {r.page_id: r.text_lang for r in langid.identify(rows, docs).collect()}
    assert got == {k: lang for k, (lang, _) in pages.items()}


def test_forms_and_asides_with_the_whole_text_speak(spark):
    pages = {"form": "<form><select><option>the of</select><label>and</label><p>und der die das</p></form>",
             "aside": "<body><aside><p>und der die das</p></aside></body>", "nav": "<nav>the of</nav><p>und der</p>", "none": "<nav></nav>"}
    rows = spark.createDataFrame(list(pages.items()), "k string, html string")
    got = {r.k: " ".join(r.t.split()) for r in rows.select("k", langid.text_of(rows.html).alias("t")).collect()}
    assert got == {"form": "und der die das", "aside": "und der die das", "nav": "und der", "none": ""}
