"""Cleaning rules over the node table. Each takes nodes and returns nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from feedloom.functions import media, text as T, urls
from feedloom.operators import dom
from feedloom.operators.dom import is_element, non_blank, node_tag, attr, has_attr

# Elements, phrases and attribute names the rules act on.
ALWAYS_REMOVED = (
    "script", "noscript", "button", "dialog", "svg", "nav", "form", "input", "select",
    "textarea", "video", "audio",
)
STANDARD_ONLY_REMOVED = ("style", "iframe")
FEED_REMOVED = ALWAYS_REMOVED + ("style", "iframe")
SIGNAL_REMOVED = (
    "script", "noscript", "style", "button", "dialog", "svg", "nav", "aside", "form",
    "input", "select", "textarea", "iframe",
)
INTERSTITIALS = (
    "article continues below", "continue reading below", "story continues below",
    "loading...", "loading…",
)
CAPTION_TOGGLES = ("hide caption", "toggle caption", "show caption")
EMPTY_TAGS = (
    "li", "span", "div", "p", "ul", "ol", "section", "aside", "header", "footer", "fieldset", "label",
)
ARIA_CONTENT_TAGS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "li", "td", "th")
IMAGE_LAYOUT_ATTRS = ("style", "class", "loading", "data-nimg", "data-chromatic")
LAZY_SRC_ATTRS = ("data-lazy-src", "data-src", "data-original", "data-orig-file")
PLACEHOLDER_MARKS = ("lazyload", "fallback", "spacer", "blank.gif", "grey-placeholder", "placeholder")
BLOCK_CONTAINERS = ("div", "section", "article", "main")
AVATAR_STYLE = "width:100px; height:100px; border-radius:50%; display:inline; margin:0 8px 0 0"

def is_img() -> Column:
    return node_tag() == "img"


def img_src() -> Column:
    return attr("src")


def img_width() -> Column:
    return media.to_int(attr("width"))


def img_height() -> Column:
    return media.to_int(attr("height"))


def node_role() -> Column:
    return attr("role")


def _class_has(word: str) -> Column:
    return F.array_contains(F.split(attr("class"), r"\s+"), word)


def is_csp_meta() -> Column:
    return (node_tag() == "meta") & (F.lower(attr("http-equiv")) == "content-security-policy")


def removed_by_tag(mode: str) -> Column:
    """EXT-02 predicate: what goes by its tag, role, class or id alone."""
    tags = {
        "standard": ALWAYS_REMOVED + STANDARD_ONLY_REMOVED,
        "full": ALWAYS_REMOVED, "feed": FEED_REMOVED, "signal": SIGNAL_REMOVED,
    }[mode]
    hit = node_tag().isin(*tags) | is_csp_meta()
    if mode == "signal":
        return hit
    hit = hit | (node_role() == "tooltip") | has_attr("data-nosnippet")
    hit = hit | attr("class").contains("newsletter") | attr("id").contains("newsletter")
    if mode == "feed":
        return hit
    return (
        hit | (node_role() == "navigation") | _class_has("comments")
        | attr("id").isin("comments", "disqus_thread")
        | (is_img() & (_class_has("hide-when-no-script") if mode == "standard" else F.lit(False)))
        | (is_img() & img_src().contains("placeholder") if mode == "standard" else F.lit(False))
    )


def remove_tags(nodes: DataFrame, mode: str = "standard") -> DataFrame:
    """EXT-02, with EXT-03 for headers and footers: inside an article they are unwrapped,
    elsewhere they go. In standard mode an aside survives, unwrapped, only as a captioned
    picture gallery."""
    out = dom.prune(nodes, removed_by_tag(mode))
    if mode in ("feed", "signal"):
        return out
    return unwrap_landmarks(out, keep_asides=mode == "full")


def unwrap_landmarks(nodes: DataFrame, keep_asides: bool = False) -> DataFrame:
    """EXT-03 for header, footer and aside."""
    marked = nodes.withColumn("_art", dom.inside(node_tag() == "article"))
    edge = node_tag().isin("header", "footer")
    out = dom.prune(marked, edge & ~F.col("_art"))
    if keep_asides:
        return dom.unwrap(out, edge).drop("_art")
    out = dom.with_contains(out, {"_captions": node_tag() == "figcaption", "_images": is_img()})
    out = out.withColumn("_gallery", (node_tag() == "aside") & F.col("_captions") & F.col("_images")).drop("_captions", "_images")
    # An aside that is inside a removed aside goes with it, gallery or not.
    out = dom.unwrap(out, edge | F.col("_gallery"))
    return dom.prune(out, node_tag() == "aside").drop("_art", "_gallery")


def unwrap_custom(nodes: DataFrame) -> DataFrame:
    """EXT-03: custom elements and figures give way to their content."""
    return dom.unwrap(nodes, is_element() & (node_tag().contains("-") | (node_tag() == "figure")))


def strip_non_content_images(nodes: DataFrame, max_dim: int = 30) -> DataFrame:
    """EXT-04."""
    return dom.prune(nodes, is_img() & media.is_non_content_image(img_src(), img_width(), img_height(), max_dim))


def strip_banner_images(nodes: DataFrame) -> DataFrame:
    """EXT-21: wide strips such as leaderboards and site logos."""
    return dom.prune(nodes, is_img() & (img_width() > 200) & (img_height() > 0) & (img_width() / img_height() > 4.0))


def constrain_avatars(nodes: DataFrame) -> DataFrame:
    """EXT-05: square author pictures become small inline images."""
    w, h = F.coalesce(img_width(), F.lit(0)), F.coalesce(img_height(), F.lit(0))
    square = (F.greatest(w, h) > 0) & (F.least(w, h) / F.greatest(w, h) >= 0.9)
    hit = is_img() & F.lower(attr("alt")).contains("avatar") & square
    small = dom.set_attrs(
        {"width": F.lit("100"), "height": F.lit("100"), "style": F.lit(AVATAR_STYLE)}
    )
    return nodes.withColumn("attrs", F.when(hit, small).otherwise(F.col("attrs")))


def strip_byline_images(nodes: DataFrame) -> DataFrame:
    """EXT-06: author avatars and small square headshots."""
    alt = T.trim_ws(F.lower(attr("alt")))
    avatar = alt.contains("'s avatar") | alt.contains("’s avatar") | F.arrays_overlap(
        media.text_segments(img_src()), F.array(F.lit("avatar"), F.lit("avatars"))
    )
    small = img_width().between(1, 200) & img_height().between(1, 200)
    square = F.least(img_width(), img_height()) / F.greatest(img_width(), img_height()) >= 0.8
    headshot = (alt.contains("headshot") | alt.startswith("photo of")) & small & square
    return dom.prune(nodes, is_img() & (avatar | F.coalesce(headshot, F.lit(False))))


def strip_image_styles(nodes: DataFrame) -> DataFrame:
    """EXT-13: attributes that only made sense in the page's own layout."""
    return nodes.withColumn(
        "attrs", F.when(is_img(), dom.drop_attrs(IMAGE_LAYOUT_ATTRS)).otherwise(F.col("attrs"))
    )


def drop_aria_hidden_content(nodes: DataFrame, full: bool = False) -> DataFrame:
    """EXT-09: text hidden for a script to reveal becomes visible; full mode drops the rest."""
    shown = F.when(node_tag().isin(*ARIA_CONTENT_TAGS), dom.drop_attrs(["aria-hidden"])).otherwise(F.col("attrs"))
    out = nodes.withColumn("attrs", shown)
    return dom.prune(out, attr("aria-hidden") == "true") if full else out


def strip_sticky(nodes: DataFrame) -> DataFrame:
    """EXT-12: floating headers lose their inline position."""
    style = F.regexp_replace(attr("style"), r"position\s*:\s*(sticky|fixed)", "position:static")
    return nodes.withColumn(
        "attrs",
        F.when(attr("style").contains("position"), dom.set_attrs({"style": style})).otherwise(F.col("attrs")),
    )


def strip_phrases(nodes: DataFrame, interstitials: bool = True, captions: bool = True) -> DataFrame:
    """EXT-10 and EXT-17: elements whose only own text is a known interface phrase."""
    s = dom.child_stats(nodes, ("n_txt", "own_text"))
    said = F.lower(F.coalesce("own_text", F.lit("")))
    single = F.col("n_txt") == 1
    hit = F.lit(False)
    if interstitials:
        hit = hit | (node_tag().isin("span", "p", "div") & single & said.isin(*INTERSTITIALS))
    if captions:
        hit = hit | ((node_tag() == "b") & single & said.isin(*CAPTION_TOGGLES))
    return dom.prune(s, hit).drop("n_txt", "own_text")


def strip_interstitials(nodes: DataFrame) -> DataFrame:
    """EXT-10."""
    return strip_phrases(nodes, captions=False)


def strip_caption_toggles(nodes: DataFrame) -> DataFrame:
    """EXT-17."""
    return strip_phrases(nodes, interstitials=False)


def strip_badge_clusters(nodes: DataFrame) -> DataFrame:
    """EXT-08: paragraphs made of two or more images, plain or each alone in a link."""
    first = dom.child_stats(nodes)
    badge = is_img() | ((node_tag() == "a") & (F.col("n_el") == 1) & (F.col("n_img") == 1) & (F.col("n_txt") == 0))
    second = dom.child_stats(first.withColumn("_badge_el", badge).drop("n_img"), (), {"n_badge": F.col("_badge_el")})
    hit = (node_tag() == "p") & (F.col("n_txt") == 0) & (F.col("n_badge") >= 2) & (F.col("n_badge") == F.col("n_el"))
    return dom.prune(second, hit).drop("n_el", "n_txt", "n_badge", "_badge_el")


def strip_thumbnail_cards(nodes: DataFrame, page_path: Column) -> DataFrame:
    """EXT-07: compact cards with a small linked picture and a linked headline.

    ``page_path`` is the lower-cased path of the page. Only the innermost card goes; what
    surrounds it is judged without it.
    """
    href = F.lower(attr("href"))
    elsewhere = (href != "") & (href != "#") & (~href.contains(page_path) | (F.length(page_path) < 2))
    small = is_img() & ((img_width() <= 240) | (img_height() <= 160))
    d = dom.with_contains(nodes, {"_small": F.coalesce(small, F.lit(False))})
    d = d.withColumn("_small_link", (node_tag() == "a") & elsewhere & F.col("_small"))
    d = d.withColumn("_head_link", (node_tag() == "a") & has_attr("href") & dom.inside(node_tag().isin("h2", "h3", "h4", "h5", "h6")))
    d = dom.with_contains(d, {"_small": F.col("_small_link"), "_head": F.col("_head_link")})
    d = d.withColumn("_linked", node_tag().isin("div", "li", "article") & F.col("_small") & F.col("_head")).drop(
        "_small", "_head", "_small_link", "_head_link")
    d = dom.subtree_sums(d, {"_chars": F.when(non_blank(), F.length(T.trim_ws(F.col("text")))).otherwise(0)}, F.col("_linked"))
    d = d.withColumn("_card", F.col("_linked") & (F.col("_chars") < 500))
    d = dom.with_contains(d, {"_inner": F.col("_card")})
    return dom.prune(d, F.col("_card") & ~F.col("_inner")).drop("_linked", "_chars", "_card", "_inner")


def strip_promo_links(nodes: DataFrame, page_url: Column) -> DataFrame:
    """EXT-22: links that hold only images and lead to another page."""
    href = attr("href")
    d = dom.child_stats(nodes).withColumn("_page", page_url)
    only_images = (
        (node_tag() == "a") & (href != "") & (href != "#") & (F.col("n_txt") == 0)
        & (F.col("n_el") > 0) & (F.col("n_el") == F.col("n_img"))
    )
    d = d.withColumn("_link", F.when(only_images, urls.resolve_url(F.col("_page"), href, upgrade=False)))
    trim = lambda p: F.regexp_replace(F.lower(p), "^/+|/+$", "")
    d = d.withColumn("_here", trim(urls.path(F.col("_page")))).withColumn("_there", trim(urls.path(F.col("_link"))))
    same = (urls.host(F.col("_link")) == urls.host(F.col("_page"))) & (
        (F.col("_there") == F.col("_here")) | (F.col("_there") == "")
    )
    hit = F.col("_link").isNotNull() & ~media.extension(F.col("_link")).isin(*media.IMAGE_EXTENSIONS) & ~same
    return dom.prune(d, hit).drop(
        "n_el", "n_img", "n_txt", "_page", "_link", "_here", "_there"
    )


def flatten_image_divs(nodes: DataFrame) -> DataFrame:
    """EXT-19: divs that hold only images, captions and further divs.

    A div keeps qualifying when the divs below it are unwrapped, so one pass is the fixpoint.
    """
    d = dom.child_stats(nodes, ("n_el", "n_txt"), {"n_ok": node_tag().isin("div", "img", "figcaption")})
    d = dom.with_contains(d, {"_has_img": is_img()})
    hit = (
        (node_tag() == "div") & (F.col("n_txt") == 0) & (F.col("n_el") > 0)
        & (F.col("n_ok") == F.col("n_el")) & F.col("_has_img")
    )
    return dom.unwrap(d, hit).drop("n_el", "n_txt", "n_ok", "_has_img")


def flatten_single_child_divs(nodes: DataFrame) -> DataFrame:
    """EXT-19: layout divs around exactly one block or image, outside header and footer."""
    d = dom.child_stats(nodes, ("n_el", "n_txt"), {"n_ok": node_tag().isin("div", "img", "picture", "figure")})
    d = d.withColumn("_edge", dom.inside(node_tag().isin("header", "footer")))
    hit = (
        (node_tag() == "div") & (F.col("n_txt") == 0) & (F.col("n_el") == 1) & (F.col("n_ok") == 1)
        & ~F.col("_edge")
    )
    return dom.unwrap(d, hit).drop("n_el", "n_txt", "n_ok", "_edge")


def strip_empty(nodes: DataFrame) -> DataFrame:
    """EXT-11: containers that hold neither text nor any element worth keeping.

    An emptied child empties its parent in turn; looking for something to keep anywhere
    below gives the same result without passes.
    """
    keeper = non_blank() | (is_element() & ~node_tag().isin(*EMPTY_TAGS))
    d = dom.with_contains(nodes, {"_full": keeper})
    return dom.prune(d, node_tag().isin(*EMPTY_TAGS) & ~F.col("_full")).drop("_full")


def wrap_standalone_images(nodes: DataFrame) -> DataFrame:
    """EXT-20: images directly in a block container become blocks of their own."""
    d = dom.with_parent(nodes, {"_ptag": node_tag()})
    wrap = is_img() & has_attr("src") & F.col("_ptag").isin(*BLOCK_CONTAINERS)
    return d.withColumn("wrap", F.coalesce(wrap, F.lit(False))).drop("_ptag")


# ---- image recovery ------------------------------------------------------------------


def promote_noscript_images(nodes: DataFrame) -> DataFrame:
    """EXT-14: the real address inside ``noscript`` moves to the placeholder next to it, or
    its image takes the place of the ``noscript``."""
    noscript = node_tag() == "noscript"
    usable = is_img() & (img_src() != "") & ~img_src().startswith("data:")
    d = dom.with_first_within(nodes, {"_real": (usable, F.struct(F.col("pre").alias("pre"), img_src().alias("src")))})
    d = d.withColumn("_real", F.when(noscript, F.col("_real")))
    level = Window.partitionBy("page_id", "parent", "_text").orderBy("pre")
    blank = is_img() & ((img_src() == "") | img_src().startswith("data:"))
    d = d.withColumn("_text", dom.is_text()).withColumn("_blank", blank)
    d = d.withColumn("_next_blank", F.coalesce(F.lead("_blank").over(level), F.lit(False)))
    d = d.withColumn("_prev_blank", F.coalesce(F.lag("_blank").over(level), F.lit(False)))
    d = d.withColumn("_promoted", F.col("_real").isNotNull() & (F.col("_next_blank") | F.col("_prev_blank")))
    # An image looks at the noscript before it, then at the one after it.
    before = F.lag(F.col("_real")).over(level)
    after = F.when(~F.lead("_next_blank").over(level), F.lead(F.col("_real")).over(level))
    d = d.withColumn("_given", F.when(F.col("_blank"), F.coalesce(before["src"], after["src"])))
    d = d.withColumn(
        "_in",
        dom.nearest(noscript, F.struct("_real", "_promoted", F.col("path").alias("path"), F.col("parent").alias("parent"))),
    )
    moved = F.coalesce(~F.col("_in._promoted") & (F.col("pre") == F.col("_in._real.pre")), F.lit(False))
    d = d.withColumn("_moved", moved).filter(~noscript & (F.col("_in").isNull() | F.col("_moved")))
    return (
        d.withColumn("attrs", F.when(F.col("_given").isNotNull(), dom.set_attrs({"src": F.col("_given")})).otherwise(F.col("attrs")))
        .withColumn("path", F.when(F.col("_moved"), F.col("_in.path")).otherwise(F.col("path")))
        .withColumn("parent", F.when(F.col("_moved"), F.col("_in.parent")).otherwise(F.col("parent")))
        .select(*nodes.columns)
    )


def _twin(name: str) -> Column:
    """Lazy twin of an attribute: the two usual names first, then any ``data-*`` one."""
    rest = F.map_values(
        F.map_filter("attrs", lambda k, v: k.startswith("data-") & k.endswith(name) & (v != ""))
    )
    empty = lambda n: F.nullif(attr(n), F.lit(""))
    return F.coalesce(empty(f"data-lazy-{name}"), empty(f"data-{name}"), F.get(rest, F.lit(0)))


def recover_placeholder_images(nodes: DataFrame) -> DataFrame:
    """EXT-15: addresses hidden in lazy-loading attributes, JSON or the surrounding link."""
    marks = "|".join(m.replace(".", r"\.") for m in PLACEHOLDER_MARKS)
    unusable = lambda c: (c == "") | c.startswith("data:")
    src = F.col("_src")
    # One projection per fallback: each reads the result of the one before it.
    d = nodes.withColumn("_src", F.when(is_img(), img_src()))
    d = d.withColumn("_ph", F.coalesce((src == "") | src.startswith("data:") | src.rlike(marks), F.lit(False)))
    lazy = F.coalesce(*[F.when(~unusable(attr(a)), attr(a)) for a in LAZY_SRC_ATTRS])
    d = d.withColumn("_src", F.when(F.col("_ph"), F.coalesce(lazy, src)).otherwise(src))
    any_src = F.get(
        F.map_values(F.map_filter(
            "attrs",
            lambda k, v: k.startswith("data-") & k.endswith("src") & ~k.endswith("srcset")
            & ~unusable(v) & v.rlike("^(?:http|/)"),
        )), F.lit(0),
    )
    d = d.withColumn("_src", F.when(F.col("_ph") & unusable(src), F.coalesce(any_src, src)).otherwise(src))
    keys = F.filter(F.json_object_keys(attr("data-srcs")), lambda k: k.startswith("http"))
    d = d.withColumn("_src", F.when(F.col("_ph") & unusable(src), F.coalesce(F.get(keys, F.lit(0)), src)).otherwise(src))
    for name in ("srcset", "sizes"):
        own = F.nullif(attr(name), F.lit(""))
        d = d.withColumn(f"_{name}", F.when(F.col("_ph"), F.coalesce(own, _twin(name))).otherwise(own))
    # The parent link, when it is a link at all, is the latest one opened before the image.
    link = dom.nearest(node_tag() == "a", F.struct(F.col("pre").alias("pre"), attr("href").alias("href")))
    d = d.withColumn("_link", link)
    to_image = (F.col("_link.pre") == F.col("parent")) & media.extension(F.col("_link.href")).isin(
        *media.LAZY_IMAGE_EXTENSIONS
    )
    d = d.withColumn("_src", F.when(src.startswith("data:") & to_image, F.col("_link.href")).otherwise(src))
    d = d.withColumn(
        "attrs", F.when(F.col("_ph"), dom.drop_attrs(["aria-hidden", "lazy-loadable"])).otherwise(F.col("attrs"))
    )
    # An address the image did not have stays absent rather than empty.
    given = dom.set_attrs({
        "src": F.coalesce(src, F.lit("")), "srcset": F.coalesce("_srcset", F.lit("")),
        "sizes": F.coalesce("_sizes", F.lit("")),
    })
    shown = F.map_filter(given, lambda k, v: (v != "") | ~k.isin("src", "srcset", "sizes"))
    return d.withColumn("attrs", F.when(is_img(), shown).otherwise(F.col("attrs"))).select(*nodes.columns)


def unwrap_picture(nodes: DataFrame) -> DataFrame:
    """EXT-16: ``picture`` gives way to its image; a source fills a missing address."""
    declared = F.when(attr("srcset") != "", attr("srcset")).otherwise(attr("data-srcset"))
    url = F.substring_index(F.trim(F.substring_index(declared, ",", 1)), " ", 1)
    picture, source = node_tag() == "picture", node_tag() == "source"
    d = nodes.withColumn("_url", F.when(source, F.nullif(url, F.lit(""))))
    offered = F.struct(F.col("pre").alias("pre"), F.col("_url").alias("url"))
    d = dom.with_first_within(d, {"_offer": (F.col("_url").isNotNull(), offered), "_img": (is_img(), F.col("pre"))})
    d = d.withColumn("_offer", F.when(picture, F.col("_offer"))).withColumn("_img", F.when(picture, F.col("_img")))
    d = d.withColumn("_in", dom.nearest(picture, F.struct("_offer", "_img", F.col("pre").alias("pre"))))
    needs = is_img() & (F.col("pre") == F.col("_in._img")) & ((img_src() == "") | img_src().startswith("data:"))
    becomes = source & F.col("_in._img").isNull() & (F.col("pre") == F.col("_in._offer.pre"))
    needs, becomes = F.coalesce(needs, F.lit(False)), F.coalesce(becomes, F.lit(False))
    offer = F.col("_in._offer.url")
    attrs = (
        F.when(needs & offer.isNotNull(), dom.set_attrs({"src": offer}))
        .when(becomes, F.create_map(F.lit("src"), offer))
        .otherwise(F.col("attrs"))
    )
    d = d.withColumn("_becomes", becomes).withColumn("attrs", attrs)
    d = d.withColumn("tag", F.when(F.col("_becomes"), "img").otherwise(node_tag()))
    d = d.filter(~((node_tag() == "source") & F.col("_in").isNotNull()))
    return dom.unwrap(d, node_tag() == "picture").select(*nodes.columns)
