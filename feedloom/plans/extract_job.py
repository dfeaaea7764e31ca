"""EXT-34: pages to article extracts.

Pages are dealt out once, as they are. One parse emits node rows, stored in buckets of pages. The
cleaning rules are windows over that layout and add no shuffle. The cleaned nodes are written once,
reliably, in the same layout; body choice, hero and final rendering all start from that copy
instead of repeating the rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedloom import schema as S
from feedloom.functions import text as T, urls
from feedloom.operators import dom, embedded, extract as E, page_rules as R
from feedloom.operators.dom import node_tag, attr
from feedloom.operators.page_store import PageStore
from feedloom.session import materialize
from feedloom.sources.html import parse_nodes


def _page(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("string").alias("page_id"), "page_url")


def _with_link_base(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """The page's address at its links, which alone are judged by it; other rows stay narrow."""
    return nodes.join(_page(pages), "page_id").withColumn("page_url", F.when(node_tag() == "a", F.col("page_url")))


def clean_standard(pages: DataFrame, store: PageStore | None = None) -> DataFrame:
    """Nodes of each page after the standard rules, ready for body choice.

    In a store the parsed nodes lie as ``parsed``.
    """
    given = embedded.inject_embedded(pages)
    n = store.keep("parsed", parse_nodes(given, buckets=store.buckets)) if store else parse_nodes(given)
    n = embedded.fill_placeholders(n, embedded.apollo_images(pages))
    n = dom.prune(n, node_tag() == "script")
    n = R.promote_noscript_images(n)
    n = R.recover_placeholder_images(n)
    n = R.unwrap_picture(n)
    n = R.drop_aria_hidden_content(n)
    n = R.strip_phrases(n)
    n = R.strip_badge_clusters(n)
    n = dom.prune(
        n,
        (R.is_img() & (R.media.is_non_content_image(R.img_src(), R.img_width(), R.img_height())
                  | F.coalesce((R.img_width() > 200) & (R.img_height() > 0) & (R.img_width() / R.img_height() > 4.0), F.lit(False))))
        | R.removed_by_tag("standard"),
    )
    n = R.constrain_avatars(R.strip_image_styles(n))
    n = R.unwrap_landmarks(n)
    n = _with_link_base(n, pages)
    n = R.strip_thumbnail_cards(n, F.lower(urls.path(F.col("page_url"))))
    n = R.strip_promo_links(n, F.col("page_url")).drop("page_url")
    n = R.unwrap_custom(n)
    n = R.flatten_single_child_divs(R.flatten_image_divs(n))
    return R.strip_empty(n).select(*dom.NODE_COLUMNS)


def clean_full(pages: DataFrame) -> DataFrame:
    """Nodes of each page after the full-page rules."""
    n = parse_nodes(embedded.inject_embedded(pages))
    n = embedded.fill_placeholders(n, embedded.apollo_images(pages))
    n = dom.prune(n, node_tag() == "script")
    n = R.promote_noscript_images(n)
    n = R.recover_placeholder_images(n)
    n = R.unwrap_picture(n)
    n = R.strip_phrases(n)
    n = R.remove_tags(n, "full")
    n = R.drop_aria_hidden_content(n, full=True)
    n = _with_link_base(n, pages)
    n = R.strip_thumbnail_cards(n, F.lower(urls.path(F.col("page_url"))))
    n = R.strip_promo_links(n, F.col("page_url")).drop("page_url")
    n = R.strip_sticky(R.strip_non_content_images(R.strip_banner_images(n)))
    return R.strip_empty(n).select(*dom.NODE_COLUMNS)


def body_text(nodes: DataFrame) -> DataFrame:
    """Rendered text of each page without its head."""
    return dom.render(dom.prune(nodes, node_tag().isin("head", "title", "meta", "link", "style")))


def _hero_rows(injected: DataFrame) -> DataFrame:
    """The image to put on top, as a node before the content."""
    return injected.filter(F.col("hero_attrs").isNotNull()).select(
        "page_id", F.lit(-1).alias("pre"), F.lit(-1).alias("last"), F.lit(-1).alias("parent"),
        F.array().cast("array<int>").alias("path"), F.lit("img").alias("tag"),
        F.col("hero_attrs").alias("attrs"), F.lit(None).cast("string").alias("text"),
        F.lit(False).alias("wrap"),
    )


def _gate(plain: Column) -> Column:
    return F.length(plain) >= S.MIN_CONTENT_CHARS


def extract_standard(pages: DataFrame) -> DataFrame:
    """``page_extract`` in reader mode. ``pages`` has page_id, page_url and html.

    ``ok`` is false, and the content null, where fewer than 50 characters of text remain.
    """
    page = _page(pages)
    with PageStore(pages) as store:
        nodes = store.keep("cleaned", R.wrap_standalone_images(clean_standard(pages, store)))
        store.drop("parsed")
        base = nodes.select(*dom.NODE_COLUMNS)
        root = store.keep("root", E.main_block(base))
        content = E.content_nodes(nodes, root).select(*dom.NODE_COLUMNS, "wrap")
        first = dom.render(content).select(
            "page_id", "html", T.word_count(F.col("plain")).alias("word_count"), F.length("plain").alias("text_chars"))
        hero = store.keep("hero", E.inject_hero(
            E.pick_hero(E.hero_candidates(base, page), page, E.og_image(base, page)), first
        ))
        spots = E.recover_dropped_images(base, content.select(*dom.NODE_COLUMNS)).join(
            hero.select("page_id", "hero_image_url"), "page_id"
        ).filter(F.col("hero_image_url").isNull() | (F.col("src") != F.col("hero_image_url")))
        lost = spots.join(base.select("page_id", "pre", "attrs"), ["page_id", "pre"]).select(
            "page_id", (F.col("before_pre") - 1).alias("pre"), (F.col("before_pre") - 1).alias("last"),
            F.lit(-1).alias("parent"), F.array().cast("array<int>").alias("path"), F.lit("img").alias("tag"),
            "attrs", F.lit(None).cast("string").alias("text"), F.lit(True).alias("wrap"),
        )
        final = dom.insert(content, _hero_rows(hero).unionByName(lost))
        final = store.keep("final", R.strip_empty(R.strip_byline_images(E.dedup_content_images(final))))
        title = store.keep("title", E.fallback_title(base))
        store.drop("cleaned")
        done = dom.render(final).select("page_id", F.col("html").alias("content_html"))
        out = (
            page.join(hero.select("page_id", "hero_image_url", "word_count", "text_chars"), "page_id", "left")
            .join(done, "page_id", "left").join(E.image_count(final), "page_id", "left")
            .join(title, "page_id", "left")
        )
        ok = F.coalesce(F.col("text_chars") >= S.MIN_CONTENT_CHARS, F.lit(False))
        return store.result(out.select(
            "page_id", "page_url", F.coalesce("title", F.lit("")).alias("title"),
            F.when(ok, F.col("content_html")).alias("content_html"),
            F.coalesce(F.when(ok, F.col("image_count")), F.lit(0)).alias("image_count"),
            F.when(ok, F.col("hero_image_url")).alias("hero_image_url"),
            F.coalesce("word_count", F.lit(0)).alias("word_count"),
            F.coalesce("text_chars", F.lit(0)).alias("text_chars"), ok.alias("ok"),
        ))


def extract_full(pages: DataFrame) -> DataFrame:
    """``page_extract`` in full mode: the whole cleaned page."""
    page = _page(pages)
    nodes = materialize(clean_full(pages))
    text = body_text(nodes).select("page_id", "plain")
    html = dom.render(nodes).select("page_id", "html")
    hero = E.pick_hero(E.hero_candidates(nodes, page, "full"), page, E.og_image(nodes, page))
    out = (
        page.join(text, "page_id", "left").join(html, "page_id", "left")
        .join(hero.select("page_id", "hero_image_url"), "page_id", "left")
        .join(E.image_count(nodes), "page_id", "left")
    )
    ok = F.coalesce(_gate(F.col("plain")), F.lit(False))
    return materialize(out.select(
        "page_id", "page_url", F.when(ok, F.col("html")).alias("content_html"),
        F.when(ok, F.col("hero_image_url")).alias("hero_image_url"),
        F.coalesce("image_count", F.lit(0)).alias("image_count"),
        F.coalesce(T.word_count(F.col("plain")), F.lit(0)).alias("word_count"),
        F.coalesce(F.length("plain"), F.lit(0)).alias("text_chars"), ok.alias("ok"),
    ))


def clean_feed_html(items: DataFrame) -> DataFrame:
    """EXT-33: article extract from feed content. ``items`` has page_id and html.

    Flat text gets paragraphs; feed content is the article already, so no body is chosen.
    """
    n = dom.prune(parse_nodes(items), R.removed_by_tag("feed"))
    n = R.strip_empty(R.strip_interstitials(n))
    block = node_tag().isin(
        "p", "div", "br", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "blockquote", "pre", "hr", "table"
    )
    facts = n.groupBy("page_id").agg(
        F.bool_or(block).alias("_blocks"), F.count_if(R.is_img()).alias("image_count"),
        F.min_by(attr("src"), F.when(R.is_img() & dom.has_attr("src"), F.col("pre"))).alias("_src"),
    )
    d = dom.render(n).join(facts, "page_id")
    html = F.when(F.col("_blocks"), F.col("html")).otherwise(T.add_paragraphs(F.col("html")))
    ok = _gate(F.col("plain"))
    hero = F.when((F.col("_src") != "") & ~F.col("_src").startswith("data:"), F.col("_src"))
    return d.select(
        "page_id", F.when(ok, html).alias("content_html"), "image_count", hero.alias("hero_image_url"),
        T.word_count(F.col("plain")).alias("word_count"), F.length("plain").alias("text_chars"), ok.alias("ok"),
    )


def page_signals(pages: DataFrame) -> DataFrame:
    """EXT-36: words and images of the body, and paywall marks of the raw page."""
    raw = pages.select(
        F.col("page_id").cast("string").alias("page_id"), T.paywall_score(F.col("html")).alias("paywall_score")
    )
    nodes = materialize(dom.prune(parse_nodes(pages), R.removed_by_tag("signal")))
    content = E.content_nodes(nodes, E.main_block(nodes)).select(*dom.NODE_COLUMNS)
    text = dom.render(content).select("page_id", T.word_count(F.col("plain")).alias("word_count"))
    return (
        raw.join(text, "page_id", "left").join(E.image_count(content), "page_id", "left")
        .select("page_id", F.coalesce("word_count", F.lit(0)).alias("word_count"),
                F.coalesce("image_count", F.lit(0)).alias("image_count"), "paywall_score")
    )


def needs_feed_fallback(extract: DataFrame, feed: DataFrame) -> DataFrame:
    """FLT-07: where the page gave too little: use feed content when there is any."""
    d = extract.join(feed.select("page_id", "rss_content_html"), "page_id", "left")
    thin = ~F.col("ok") | (F.col("word_count") < S.MIN_CONTENT_WORDS)
    has_feed = F.coalesce(F.col("rss_content_html") != "", F.lit(False))
    return d.withColumn(
        "content_from", F.when(~thin, "page").when(has_feed, "feed").otherwise("none")
    ).drop("rss_content_html")
