"""Choosing the article body, title, hero and images of cleaned pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from feedloom.functions import media, text as T, urls
from feedloom.operators import dom
from feedloom.operators.dom import is_element, non_blank, node_tag, attr, has_attr
from feedloom.operators.page_rules import img_height, is_img, img_src, img_width
from feedloom.operators.skew import first_per_key

# Words that mark an image as page chrome; full mode knows fewer of them.
CHROME_WORDS_FULL = (
    "logo", "flag", "icon", "badge", "spinner", "facebook", "twitter", "instagram", "pinterest",
    "tiktok", "furniture", "share", "follow", "comment", "thumbnail", "banner", "bkgd", "headshot",
)
CHROME_WORDS = CHROME_WORDS_FULL + ("reactions", "blank", "spacer")
SCORED_TAGS = ("p", "pre", "td", "blockquote")
MIN_PARAGRAPH_CHARS = 25


# ---- body choice ---------------------------------------------------------------------


def main_block(nodes: DataFrame) -> DataFrame:
    """EXT-25: the element that holds the article, one row per page.

    The published readability idea: a paragraph scores by its length and commas, its parent
    gets the full score and its grandparent half, and link-heavy blocks are discounted. Pages
    without a scoring paragraph fall back to the first of ``content_scopes`` that holds text
    (of several the one with most), then to their body, then to their first element.
    """
    n = nodes.withColumn("_in_link", dom.inside(node_tag() == "a")).withColumn(
        "_chars", F.when(non_blank(), F.length(T.trim_ws(F.col("text")))).otherwise(0)
    )
    scope = F.coalesce(*[F.when(c, F.lit(-k)) for k, c in enumerate(content_scopes())])
    # From here on no column of the page's content is needed.
    n = n.select(
        "page_id", "pre", "last", "tag", "path", scope.alias("scope"), F.col("_chars").alias("chars"),
        F.when(F.col("_in_link"), F.col("_chars")).otherwise(0).alias("link_chars"),
        F.when(non_blank(), F.regexp_count("text", F.lit("[,，、]"))).otherwise(0).alias("commas"))
    n = dom.subtree_sums(n, {c: F.col(c) for c in ("chars", "link_chars", "commas")}).filter(is_element())
    points = F.when(
        node_tag().isin(*SCORED_TAGS) & (F.col("chars") >= MIN_PARAGRAPH_CHARS),
        1 + F.col("commas") + F.least(F.floor(F.col("chars") / 100), F.lit(3)),
    )
    n = n.withColumn("_points", points).withColumn(
        "_bonus", F.when(node_tag().isin("article", "section", "div"), 5).when(node_tag().isin("pre", "td", "blockquote"), 3).otherwise(0)
    )
    n = dom.near_sums(n, F.col("_points"), ("_near", "_far"))
    raw = F.coalesce("_near", F.lit(0)) + F.coalesce("_far", F.lit(0)) / 2
    score = (raw + F.col("_bonus")) * (1 - F.col("link_chars") / F.greatest("chars", F.lit(1)))
    declared = F.col("scope").isNotNull() & (F.col("chars") > 0)
    # Candidates first, then what the page declares its content, then the body, then the root.
    rank = F.struct(
        F.when(raw > 0, 3).when(declared, 2).when(node_tag() == "body", 1).otherwise(0).alias("kind"),
        F.when(raw > 0, F.round(score, 6)).when(declared, F.col("scope")).otherwise(0.0).alias("score"),
        F.when((raw <= 0) & declared, F.col("chars")).otherwise(0).alias("held"), (-F.col("pre")).alias("order"),
    )
    best = F.max_by(F.struct("pre", "last", F.col("tag").alias("root_tag")), rank)
    return n.groupBy("page_id").agg(best.alias("_b")).select(
        "page_id", F.col("_b.pre").alias("root_pre"), F.col("_b.last").alias("root_last"), "_b.root_tag"
    )


def content_nodes(nodes: DataFrame, root: DataFrame) -> DataFrame:
    """Nodes inside the chosen body."""
    return (
        nodes.join(root.select("page_id", "root_pre", "root_last"), "page_id")
        .filter((F.col("pre") > F.col("root_pre")) & (F.col("pre") <= F.col("root_last")))
    )


def fallback_title(nodes: DataFrame) -> DataFrame:
    """FN-27: the page title before `` | ``, else the first heading."""
    titled = nodes.withColumn(
        "_t", dom.nearest(node_tag() == "title", F.col("pre"))
    ).withColumn("_h", dom.nearest(node_tag() == "h1", F.col("pre")))
    rows = titled.filter(dom.is_text() & (F.col("_t").isNotNull() | F.col("_h").isNotNull()))
    # Text pieces of the first title and of the first heading, in order.
    def gather(kind: str) -> Column:
        pieces = F.array_sort(F.collect_list(F.when(F.col(kind).isNotNull(), F.struct(F.col(kind).alias("el"), F.col("pre").alias("pre"), F.col("text").alias("text")))))
        first = F.filter(pieces, lambda p: p["el"] == F.get(pieces, F.lit(0))["el"])
        joined = F.array_join(F.transform(first, lambda p: p["text"]), "")
        return F.trim(F.regexp_replace(joined, r"[\s\u00a0]+", " "))

    agg = rows.groupBy("page_id").agg(gather("_t").alias("_title"), gather("_h").alias("_head"))
    return agg.select(
        "page_id",
        F.coalesce(
            F.nullif(F.trim(F.substring_index("_title", " | ", 1)), F.lit("")),
            F.nullif("_head", F.lit("")), F.lit(""),
        ).alias("title"),
    )


def og_image(nodes: DataFrame, page: DataFrame) -> DataFrame:
    """EXT-18: the declared page image, the social one as a second choice."""
    kind = F.when((node_tag() == "meta") & (attr("property") == "og:image"), 0).when(
        (node_tag() == "meta") & (attr("name") == "twitter:image"), 1
    )
    meta = nodes.withColumn("_kind", kind).filter(F.col("_kind").isNotNull())
    # Only the first tag of each kind counts, even when it is empty.
    firsts = first_per_key(meta.withColumn("_content", attr("content")), ["page_id", "_kind"], [F.col("pre")], ["_content"])
    best = firsts.filter("_content <> ''").groupBy("page_id").agg(F.min_by("_content", "_kind").alias("_content"))
    return best.join(page, "page_id").select(
        "page_id", urls.resolve_url(F.col("page_url"), F.col("_content")).alias("og_image")
    )


# ---- hero ----------------------------------------------------------------------------


def hero_candidates(nodes: DataFrame, page: DataFrame, mode: str = "standard") -> DataFrame:
    """EXT-26: image rows with ``acceptable``, the selector rank and whether main encloses it.

    ``page`` has ``page_id`` and ``page_url``.
    """
    words = CHROME_WORDS if mode == "standard" else CHROME_WORDS_FULL
    word_array = F.array(*[F.lit(w) for w in words])
    n = (
        nodes.withColumn("_article", dom.inside(node_tag() == "article"))
        .withColumn("_body", dom.inside(attr("itemprop") == "articleBody"))
        .withColumn("_main", dom.inside(node_tag() == "main"))
        .withColumn("_role", dom.inside(attr("role") == "main"))
        .withColumn("_link", dom.nearest((node_tag() == "a") & (attr("href") != ""), F.struct(F.col("pre").alias("pre"), attr("href").alias("href"))))
    )
    img = n.filter(is_img() & has_attr("src")).join(page, "page_id")
    img = img.withColumn("src", img_src()).withColumn("_low", F.lower("src"))
    img = img.withColumn("_alt", F.lower(attr("alt"))).withColumn("_id", F.lower(attr("id")))
    w, h = img_width(), img_height()
    no = lambda c: F.coalesce(c, F.lit(False))
    bad_size = (
        no(w < 120) | no(h < 120) | no((w <= 250) & (h <= 250)) | no((w < h) & (w <= 200))
        | no((h > 0) & (w / h > 4.0))
        | no(media.to_int(F.regexp_extract(urls.query(F.col("src")), r"(?:^|&)w=([^&]*)", 1)) <= 150)
    )
    low = F.col("_low")
    segments = F.concat(*[media.text_segments(F.col(c)) for c in ("_id", "_alt", "_low")])
    chrome = (
        low.contains(".svg") | (attr("itemprop") == "logo") | F.arrays_overlap(segments, word_array)
        | low.rlike(r"/avatars?/|/avatar\.|/avatar_|/authors/") | F.col("_id").contains("avatar")
        | F.col("_alt").rlike("^(?:background|foreground)")
    )
    if mode == "standard":
        chrome = chrome | low.contains("/wp-content/themes/")
    img = img.withColumn("_bad", bad_size | chrome | (F.col("src") == "") | F.col("src").startswith("data:"))
    # Links up to five levels above; a link to an image file is a zoom link.
    near = F.array_contains(F.slice(F.reverse("path"), 1, 5), F.col("_link.pre"))
    img = img.withColumn("_target", F.when(no(near), urls.resolve_url(F.col("page_url"), F.col("_link.href"), upgrade=False)))
    trim = lambda c: F.regexp_replace(urls.path(c), "^/+|/+$", "")
    target = trim(F.col("_target"))
    away = no(
        ~media.extension(F.col("_target")).isin(*media.IMAGE_EXTENSIONS)
        & (target != "") & (target != trim(F.col("page_url")))
    )
    img = img.withColumn("_bad", F.col("_bad") | away)
    if mode == "standard":
        pattern = "^(?:" + "|".join(words) + ")(?:-|$)"
        tokens = F.flatten(F.transform(F.map_values("attrs"), lambda v: F.split(F.lower(v), " ")))
        marked = (attr("aria-hidden") == "true") | F.exists(tokens, lambda t: t.rlike(pattern))
        above = (
            dom.ancestors(nodes, is_img() & has_attr("src"), 2, {"_marked": marked})
            .groupBy("page_id", "pre").agg(F.bool_or("_marked").alias("_near_chrome"))
        )
        img = img.join(above, ["page_id", "pre"], "left").withColumn(
            "_bad", F.col("_bad") | no(F.col("_near_chrome"))
        )
    rank = F.when(F.col("_article"), 0).when(F.col("_body"), 1).when(F.col("_main"), 2).when(F.col("_role"), 3).otherwise(4)
    return img.select(
        "page_id", "pre", "src", "attrs", rank.alias("selector_rank"),
        (F.col("_main") | F.col("_role")).alias("in_main"), (~F.col("_bad")).alias("acceptable"),
    )


def pick_hero(candidates: DataFrame, page: DataFrame, og: DataFrame) -> DataFrame:
    """WIN-13: first acceptable image by selector, then in the page, else the declared one.

    One row per page: ``first_*`` is the chosen image, ``main_*`` the first one in main, and
    ``scoped`` tells whether the choice came from a content selector.
    """
    ok = candidates.filter("acceptable")
    value = F.struct("src", "attrs")
    picked = ok.groupBy("page_id").agg(
        F.min_by(value, F.struct("selector_rank", "pre")).alias("_first"),
        F.min("selector_rank").alias("_rank"),
        F.min_by(value, F.when(F.col("in_main"), F.col("pre"))).alias("_main"),
    )
    return (
        page.select("page_id", "page_url").join(picked, "page_id", "left").join(og, "page_id", "left")
        .select(
            "page_id", "page_url", F.col("_first.src").alias("first_src"),
            F.col("_first.attrs").alias("first_attrs"),
            F.coalesce(F.col("_rank") < 4, F.lit(False)).alias("scoped"),
            F.col("_main.src").alias("main_src"), F.col("_main.attrs").alias("main_attrs"),
            "og_image", F.coalesce("_first.src", "og_image").alias("hero_image_url"),
        )
    )


def _present(html: Column, src: Column, absolute: Column) -> Column:
    encoded = F.replace(absolute, F.lit("&"), F.lit("&amp;"))
    return F.coalesce(html.contains(src) | html.contains(absolute) | html.contains(encoded), F.lit(False))


def inject_hero(hero: DataFrame, content: DataFrame) -> DataFrame:
    """EXT-27: the final hero and the attributes of an image to put on top, if any.

    ``content`` has ``page_id`` and ``html``; its further columns are handed on. An image counts
    as present in its raw, absolute or escaped form. When the scoped choice is present already,
    an earlier image in main that was dropped takes its place.
    """
    d = hero.join(content, "page_id")
    for name in ("first", "main"):
        d = d.withColumn(f"_{name}_abs", urls.resolve_url(F.col("page_url"), F.col(f"{name}_src"), upgrade=False))
        d = d.withColumn(f"_{name}_in", _present(F.col("html"), F.col(f"{name}_src"), F.col(f"_{name}_abs")))
    d = d.withColumn("_og_in", _present(F.col("html"), F.col("og_image"), F.col("og_image")))
    use_main = F.coalesce(
        F.col("scoped") & F.col("_first_in") & (F.col("main_src") != F.col("first_src")) & ~F.col("_main_in"),
        F.lit(False),
    )
    d = d.withColumn("_use_main", use_main)
    tag = (
        F.when(F.col("_use_main"), F.col("main_attrs"))
        .when(F.col("first_src").isNotNull(), F.when(~F.col("_first_in"), F.col("first_attrs")))
        .when(F.col("og_image").isNotNull() & ~F.col("_og_in"), F.create_map(F.lit("src"), F.col("og_image")))
    )
    return d.select(
        "page_id",
        F.when(F.col("_use_main"), F.col("main_src")).otherwise(F.coalesce("first_src", "og_image")).alias("hero_image_url"),
        tag.alias("hero_attrs"), *[c for c in content.columns if c not in ("page_id", "html")],
    )


# ---- image deduplication -------------------------------------------------------------


def duplicate_images(images: DataFrame) -> DataFrame:
    """WIN-11: ``duplicate`` per image row (page_id, pre, src): same address, then same path
    with identifying parameters, then same host and file, each in document order.

    A finer key implies the coarser one, so three rankings equal the greedy scan. A missing
    key never makes a duplicate.
    """
    usable = (F.col("src") != "") & ~F.col("src").startswith("data:")
    d = images.withColumn("_k0", F.when(usable, F.col("src")))
    d = d.withColumn("_k1", F.when(usable, media.base_path_key(F.col("src"))))
    d = d.withColumn("_k2", F.when(usable, media.host_file_key(F.col("src"))))
    dup = F.lit(False)
    for k in ("_k0", "_k1", "_k2"):
        rank = F.row_number().over(Window.partitionBy("page_id", k).orderBy("pre"))
        d = d.withColumn(f"{k}_r", rank)
        dup = dup | (F.col(k).isNotNull() & (F.col(f"{k}_r") > 1))
    return d.withColumn("duplicate", dup).drop("_k0", "_k1", "_k2", "_k0_r", "_k1_r", "_k2_r")


def sibling_duplicates(images: DataFrame) -> DataFrame:
    """WIN-12: ``sibling_duplicate`` per image row: of size variants under one parent the
    widest stays, the first of equals."""
    usable = (F.col("src") != "") & ~F.col("src").startswith("data:")
    d = images.withColumn("_k", F.when(usable, media.image_dedup_key(F.col("src"))))
    w = Window.partitionBy("page_id", "parent", "_k").orderBy(F.coalesce("width", F.lit(0)).desc(), "pre")
    return d.withColumn("_r", F.row_number().over(w)).withColumn(
        "sibling_duplicate", F.col("_k").isNotNull() & (F.col("_r") > 1)
    ).drop("_k", "_r")


def image_rows(nodes: DataFrame) -> DataFrame:
    return nodes.filter(is_img() & has_attr("src")).select(
        "page_id", "pre", "parent", img_src().alias("src"), img_width().alias("width"), img_height().alias("height")
    )


def dedup_content_images(nodes: DataFrame) -> DataFrame:
    """Both deduplications on a node table, rank by rank, without leaving the page's rows."""
    usable = is_img() & (img_src() != "") & ~img_src().startswith("data:")
    d = nodes.withColumn("_src", F.when(usable, img_src()))
    d = d.withColumn("_k1", media.base_path_key(F.col("_src"))).withColumn("_k2", media.host_file_key(F.col("_src")))
    keep = F.lit(True)
    for k in ("_src", "_k1", "_k2"):
        d = d.withColumn(f"{k}_r", F.row_number().over(Window.partitionBy("page_id", k).orderBy("pre")))
        keep = keep & (F.col(k).isNull() | (F.col(f"{k}_r") == 1))
    d = d.filter(keep).withColumn("_k3", media.image_dedup_key(F.col("_src")))
    widest = Window.partitionBy("page_id", "parent", "_k3").orderBy(F.coalesce(img_width(), F.lit(0)).desc(), "pre")
    d = d.withColumn("_k3_r", F.row_number().over(widest))
    return d.filter(F.col("_k3").isNull() | (F.col("_k3_r") == 1)).select(*nodes.columns)


# ---- dropped images ------------------------------------------------------------------


def block_texts(nodes: DataFrame) -> DataFrame:
    """Normalized text of every paragraph and heading: (page_id, pre, parent, text)."""
    block = node_tag().isin("p", "h1", "h2", "h3", "h4", "h5", "h6")
    pieces = nodes.filter(non_blank()).select("page_id", "pre", F.col("text"), F.explode("path").alias("_anc"))
    blocks = nodes.filter(block).select("page_id", F.col("pre").alias("_anc"), F.col("parent"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "text"))), lambda p: p["text"]), "")
    return (
        pieces.join(blocks, ["page_id", "_anc"])
        .groupBy("page_id", F.col("_anc").alias("pre"), "parent")
        .agg(F.trim(F.regexp_replace(joined, r"[\s\u00a0]+", " ")).alias("text"))
    )


def content_scopes() -> list[Column]:
    """Elements that hold the content, in order of preference."""
    return [node_tag() == "article", node_tag() == "main", dom.attr("role") == "main", dom.attr("itemprop") == "articleBody"]


def recover_dropped_images(nodes: DataFrame, content: DataFrame, min_chars: int = 20) -> DataFrame:
    """JOIN-17: where to put back images that body choice lost.

    For an image whose address the content lacks: the next paragraph or heading of at least
    20 characters beside its block, and the first block of the content with the same text.
    Images come from the first of ``content_scopes`` that holds any on the page, else from the
    whole page. Returns (page_id, pre, src, before_pre).
    """
    scoped = nodes.withColumn("_in", F.array(*[dom.inside(c) for c in content_scopes()]))
    held = F.when(is_img() & has_attr("src"), (F.array_position("_in", True) - 1).cast("int"))
    first = F.min(F.when(held >= 0, held)).over(Window.partitionBy("page_id"))
    nodes = scoped.withColumn("_first", first).withColumn("_scoped", F.coalesce(F.get("_in", F.col("_first")), F.lit(True)))
    wanted_img = is_img() & has_attr("src") & (img_src() != "") & ~img_src().startswith("data:") & F.col("_scoped")
    texts = block_texts(nodes).filter(F.length("text") >= min_chars)
    inline = node_tag().isin("a", "span", "em", "strong", "b", "i")
    # The block an image sits in: its paragraph, or the last inline wrapper below a block.
    up = dom.ancestors(nodes, wanted_img, None,
                       {"_ok": inline, "_p": node_tag() == "p", "_pre": F.col("pre"), "_parent": F.col("parent")})
    walk = Window.partitionBy("page_id", "pre").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    chain = up.withColumn("_open", F.coalesce(F.min(F.col("_ok").cast("int")).over(walk), F.lit(1)) == 1)
    anchor = chain.filter(F.col("_open") & (F.col("_ok") | F.col("_p"))).groupBy("page_id", "pre").agg(
        F.max_by(F.struct("_pre", "_parent"), "level").alias("_a"))
    src = nodes.filter(wanted_img).select(
        "page_id", "pre", "parent", img_src().alias("src"))
    img = src.join(anchor, ["page_id", "pre"], "left").select(
        "page_id", "pre", "src", F.coalesce("_a._parent", "parent").alias("parent"),
        F.coalesce("_a._pre", "pre").alias("at"))
    # The images of a parent come as one list at its first text; a union would hash the texts anew.
    # Where there is no text, there is none beside an image.
    beside = texts.withColumn("_first", F.row_number().over(Window.partitionBy("page_id", "parent").orderBy("pre")) == 1).join(
        img.groupBy("page_id", "parent").agg(F.collect_list(F.struct("at", "pre", "src")).alias("_images")), ["page_id", "parent"])
    none = [F.lit(None).cast("int").alias("pre"), F.lit(None).cast("string").alias("src")]
    itself = F.array(F.struct(F.col("pre").alias("at"), *none, "text"))
    images = F.transform("_images", lambda i: F.struct(i["at"].alias("at"), i["pre"].alias("pre"), i["src"].alias("src"), F.lit(None).cast("string").alias("text")))
    beside = beside.select("page_id", "parent", F.inline(F.when(F.col("_first"), F.concat(itself, images)).otherwise(itself)))
    # An image's own block is none that follows it.
    ahead = Window.partitionBy("page_id", "parent").orderBy(F.col("at").desc(), F.col("src").isNull()).rowsBetween(
        Window.unboundedPreceding, -1)
    wanted = (
        beside.withColumn("_next", F.last("text", ignorenulls=True).over(ahead))
        .filter(F.col("src").isNotNull() & F.col("_next").isNotNull())
        .select("page_id", "pre", "src", F.col("_next").alias("text"))
    )
    have = content.filter(is_img()).select("page_id", img_src().alias("src")).distinct()
    spots = block_texts(content).groupBy("page_id", "text").agg(F.min("pre").alias("before_pre"))
    return (
        wanted.join(have, ["page_id", "src"], "left_anti").join(spots, ["page_id", "text"])
        .select("page_id", "pre", "src", "before_pre")
    )


# ---- page facts ----------------------------------------------------------------------


def image_count(nodes: DataFrame) -> DataFrame:
    """AGG-11."""
    return nodes.groupBy("page_id").agg(F.count_if(is_img()).alias("image_count"))


def content_images(nodes: DataFrame) -> DataFrame:
    """EXT-38: image addresses in document order, the lazy one where there is no other."""
    src = F.coalesce(F.nullif(img_src(), F.lit("")), F.nullif(attr("data-src"), F.lit("")))
    rows = nodes.filter(is_img()).select("page_id", "pre", src.alias("src")).filter(F.col("src").isNotNull())
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pre", "src"))), lambda x: x["src"])
    return rows.groupBy("page_id").agg(ordered.alias("image_urls"))


def discover_feed_links(nodes: DataFrame, page: DataFrame) -> DataFrame:
    """EXT-35: the first alternate link that declares a feed type."""
    kind = F.lower(attr("type"))
    link = nodes.filter(
        (node_tag() == "link") & (attr("rel") == "alternate") & (kind.contains("rss") | kind.contains("atom"))
        & (attr("href") != "")
    )
    first = link.groupBy("page_id").agg(F.min_by(attr("href"), "pre").alias("_href"))
    return first.join(page, "page_id").select(
        "page_id", urls.resolve_url(F.col("page_url"), F.col("_href")).alias("feed_url")
    )


def pick_favicon(nodes: DataFrame, page: DataFrame) -> DataFrame:
    """WIN-15: largest touch icon, else largest icon, else the well-known path."""
    rel = attr("rel")
    touch = rel.isin("apple-touch-icon", "apple-touch-icon-precomposed")
    sizes = F.lower(attr("sizes"))
    links = nodes.filter((node_tag() == "link") & rel.rlike("(?i)icon") & (attr("href") != "")).join(page, "page_id")
    links = links.withColumn("_url", urls.resolve_url(F.col("page_url"), attr("href"), upgrade=False))
    usable = links.filter(media.extension(F.col("_url")) != "svg")
    size = F.coalesce(media.to_int(F.substring_index(sizes, "x", 1)), F.lit(0))
    # A touch icon without a fixed size is no touch icon, but may still serve as an icon.
    kind = F.when(touch & (sizes != "any"), 0).otherwise(1)
    best = usable.groupBy("page_id").agg(F.min_by("_url", F.struct(kind, -size, F.col("pre"))).alias("_icon"))
    well_known = F.concat(
        F.coalesce(F.nullif(urls.scheme(F.col("page_url")), F.lit("")), F.lit("https")), F.lit("://"),
        urls.host(F.col("page_url")), F.lit("/favicon.ico"),
    )
    return page.join(best, "page_id", "left").select("page_id", F.coalesce("_icon", well_known).alias("icon_url"))


EXCERPT_CHARS, EXCERPT_PARAGRAPHS = 1500, 5


def excerpt(paragraph: DataFrame, key: str = "page_id") -> DataFrame:
    """WIN-16: up to five paragraphs and 1500 characters; the paragraph that would overflow
    is cut at its last full stop, else at its last space.

    ``paragraph`` has the key, ``pos`` and ``text``. Leading paragraphs below 20 characters,
    such as bylines, are skipped.
    """
    w = Window.partitionBy(key).orderBy("pos")
    so_far, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    d = paragraph.withColumn("text", T.trim_ws(F.col("text"))).filter("text <> ''")
    d = d.withColumn("_len", F.length("text"))
    d = d.filter(F.col("_len") > 0).withColumn("_open", F.max((F.col("_len") >= 20).cast("int")).over(so_far)).filter("_open = 1")
    d = d.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= EXCERPT_PARAGRAPHS)
    d = d.withColumn("_used", F.coalesce(F.sum("_len").over(before), F.lit(0)))
    over = (F.col("_used") + F.col("_len") > EXCERPT_CHARS) & (F.col("_n") > 1)
    d = d.withColumn("_over", over).withColumn("_past", F.coalesce(F.max(over.cast("int")).over(before), F.lit(0)))
    d = d.filter("_past = 0")
    left = (EXCERPT_CHARS - F.col("_used")).cast("int")
    d = d.withColumn("_cut", F.substring(F.col("text"), F.lit(1), left))
    stop = F.regexp_extract("_cut", r"(?s)^(.*\.)", 1)
    space = F.regexp_extract("_cut", r"(?s)^(.* )", 1)
    tail = F.when(left <= 50, F.lit("")).when(stop != "", stop).when(space != "", F.concat(space, F.lit("…"))).otherwise(F.lit(""))
    d = d.withColumn("_part", F.when(F.col("_over"), tail).otherwise(F.col("text"))).filter("_part <> ''")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("_n", "_part"))), lambda p: p["_part"])
    return d.groupBy(key).agg(F.array_join(parts, "\n\n").alias("excerpt"))
