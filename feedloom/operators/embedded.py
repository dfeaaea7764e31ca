"""Content that pages carry as JSON inside scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from feedloom.functions import text as T
from feedloom.operators import dom
from feedloom.operators.dom import is_element, node_tag, attr

MIN_EMBEDDED_CHARS = 200


def json_strings(js: Column) -> Column:
    """All string literals of a JSON text, decoded, in order.

    Escaped backslashes and quotes are set aside first, so that the remaining quotes
    alternate between opening and closing; no recursion over the structure is needed.
    """
    safe = F.replace(F.replace(js, F.lit("\\\\"), F.lit("\u0001")), F.lit('\\"'), F.lit("\u0002"))
    inner = F.filter(F.split(safe, '"'), lambda _, i: i % 2 == 1)
    raw = F.transform(
        inner, lambda s: F.replace(F.replace(s, F.lit("\u0002"), F.lit('\\"')), F.lit("\u0001"), F.lit("\\\\"))
    )
    return raw


def decode_literal(s: Column) -> Column:
    return F.get(F.from_json(F.concat(F.lit('["'), s, F.lit('"]')), "array<string>"), F.lit(0))


def with_embedded_article(pages: DataFrame) -> DataFrame:
    """EXT-23: adds ``embedded_html``: the longest string with a paragraph in the page's
    embedded JSON, unless its text already shows in the body."""
    script = F.regexp_extract("html", r"""(?is)<script[^>]*\bid=["']?__NEXT_DATA__["']?[^>]*>(.*?)</script>""", 1)
    d = pages.withColumn("_js", F.when(F.col("html").contains("__NEXT_DATA__"), script))
    d = d.withColumn("_ok", F.expr("try_parse_json(_js)").isNotNull())
    long = F.filter(
        F.transform(
            F.filter(json_strings(F.col("_js")), lambda s: F.length(s) > MIN_EMBEDDED_CHARS), decode_literal
        ),
        lambda s: (F.length(s) > MIN_EMBEDDED_CHARS) & s.contains("<p>"),
    )
    best = F.array_max(
        F.transform(long, lambda s, i: F.struct(F.length(s).alias("n"), (-i).alias("i"), s.alias("s")))
    )
    d = d.withColumn("_best", F.when(F.col("_ok"), best["s"]))
    strip = lambda c: F.trim(F.regexp_replace(T.unescape(F.regexp_replace(c, "<[^>]*>", " ")), r"[\s\u00a0]+", " "))
    d = d.withColumn("_plain", F.when(F.col("_best").isNotNull(), strip(F.col("_best"))))
    body = F.regexp_replace("html", r"(?is)<(script|style|head)\b.*?</\1>|<!--.*?-->", " ")
    d = d.withColumn("_body", F.when(F.col("_best").isNotNull(), strip(body)))
    known = (F.length("_plain") > MIN_EMBEDDED_CHARS) & F.col("_body").contains(F.substring("_plain", 101, 60))
    return d.withColumn("embedded_html", F.when(~F.coalesce(known, F.lit(False)), F.col("_best"))).drop(
        "_js", "_ok", "_best", "_plain", "_body"
    )


def inject_embedded(pages: DataFrame) -> DataFrame:
    """Pages with their embedded article put at the end of the body."""
    d = with_embedded_article(pages)
    extra = F.concat(F.lit('<article id="next-data-article">'), F.col("embedded_html"), F.lit("</article>"))
    closes = F.col("html").rlike("(?i)</body>")
    at = F.regexp_instr("html", F.lit("(?i)</body>"))
    spliced = F.when(
        closes, F.concat(F.expr("substring(html, 1, regexp_instr(html, '(?i)</body>') - 1)"), extra, F.col("html").substr(at, F.length("html")))
    ).otherwise(F.concat("html", extra))
    return d.withColumn("html", F.when(F.col("embedded_html").isNull(), F.col("html")).otherwise(spliced)).drop("embedded_html")


_MAP = "map<string,string>"


def _first_with_prefix(m: Column, prefix: str) -> Column:
    return F.get(F.map_values(F.map_filter(m, lambda k, _: k.startswith(prefix))), F.lit(0))


def apollo_images(pages: DataFrame) -> DataFrame:
    """EXT-24: image addresses of the serialized client cache, in article order.

    Returns (page_id, n, url), n counting from 1. Nested objects stay JSON text until they are
    looked into, so unknown keys cost nothing.
    """
    js = F.regexp_extract("html", r"(?s)__APOLLO_STATE__[^{]*?(\{.*?)</script>", 1)
    d = pages.filter(F.col("html").contains("__APOLLO_STATE__")).select("page_id", F.from_json(js, _MAP).alias("_s"))
    d = d.withColumn("_root", F.map_values(F.from_json(F.try_element_at("_s", F.lit("ROOT_QUERY")), _MAP)))
    typed = F.filter("_root", lambda v: F.get_json_object(v, "$.__typename") == "Article")
    shaped = F.filter(
        "_root", lambda v: F.exists(F.map_keys(F.from_json(v, _MAP)), lambda k: k.startswith("segments"))
    )
    d = d.withColumn("_article", F.from_json(F.coalesce(F.get(typed, F.lit(0)), F.get(shaped, F.lit(0))), _MAP))
    d = d.withColumn("_segs", F.from_json(_first_with_prefix(F.col("_article"), "segments"), f"array<{_MAP}>"))

    def holders(seg: Column) -> Column:
        # The segment's own image comes before the images of its gallery.
        gallery = F.try_element_at("_s", F.get_json_object(_first_with_prefix(seg, "gallery"), "$.__ref"))
        items = _first_with_prefix(F.from_json(gallery, _MAP), "galleryitems")
        nodes = F.from_json(F.get_json_object(items, "$.nodes"), f"array<{_MAP}>")
        return F.concat(F.array(seg), F.coalesce(nodes, F.array().cast(f"array<{_MAP}>")))

    shown = F.filter("_segs", lambda s: F.coalesce(F.try_element_at(s, F.lit("type")), F.lit("")) != "CALL_TO_ACTION")
    d = d.withColumn("_refs", F.transform(
        F.flatten(F.transform(shown, holders)),
        lambda h: F.get_json_object(_first_with_prefix(h, "image"), "$.__ref"),
    ))
    d = d.withColumn("_entries", F.transform(
        F.filter("_refs", lambda r: r.startswith("Image:")), lambda r: F.try_element_at("_s", r)
    ))
    d = d.withColumn("_urls", F.transform("_entries", lambda e: F.replace(
        F.coalesce(*[F.get_json_object(e, f"$.{k}") for k in ("uri", "url", "src")]), F.lit("\\u002F"), F.lit("/"))))
    usable = F.filter("_urls", lambda u: F.coalesce(u != "", F.lit(False)))
    return d.select("page_id", F.posexplode(usable).alias("_i", "url")).select(
        "page_id", (F.col("_i") + 1).alias("n"), "url"
    )


def fill_placeholders(nodes: DataFrame, image: DataFrame) -> DataFrame:
    """EXT-24: the n-th empty aspect-ratio box becomes the n-th image.

    A page's images come as one list, so that its nodes stay in page order for the join.
    """
    long_text = dom.is_text() & (F.length(T.trim_ws(F.col("text"))) >= 10)
    empty = is_element() & attr("style").rlike(r"padding-top\s*:\s*[\d.]+%") & ~F.col("_filled")
    w = Window.partitionBy("page_id").orderBy("pre")
    d = dom.with_contains(nodes, {"_filled": is_element() | long_text}).withColumn("_box", empty).drop("_filled")
    d = d.withColumn("n", F.when(F.col("_box"), F.sum(F.col("_box").cast("int")).over(w)).otherwise(0))
    lists = image.groupBy(F.col("page_id").cast("string").alias("page_id")).agg(F.sort_array(F.collect_list(F.struct("n", "url"))).alias("_images"))
    nth = F.get(F.filter("_images", lambda i: i["n"] == F.col("n")), F.lit(0))["url"]
    d = d.join(lists, "page_id", "left").withColumn("url", F.when(F.col("_box"), nth)).drop("_images")
    hit = F.col("url").isNotNull()
    d = d.withColumn("_hit", hit).withColumn("_in_hit", dom.inside(F.col("_hit"))).filter(~F.col("_in_hit"))
    return (
        d.withColumn("tag", F.when(F.col("_hit"), "img").otherwise(node_tag()))
        .withColumn("attrs", F.when(F.col("_hit"), F.create_map(F.lit("src"), F.col("url"), F.lit("loading"), F.lit("lazy"))).otherwise(F.col("attrs")))
        .select(*nodes.columns)
    )
