"""Images and stylesheets a stored page needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from feedloom import schema as S
from feedloom.functions import media, urls
from feedloom.operators import dom
from feedloom.operators.dom import node_tag, attr
from feedloom.operators.page_rules import is_img, img_src

LOCAL = "./assets/"


def _usable(u: Column) -> Column:
    return F.when((u != "") & ~u.startswith("data:") & ~media.is_placeholder_image(u), u)


def _present(u: Column) -> Column:
    """The address, with rows that have none left out.

    An exploded filter, because a plain one would be pushed below the projections that build
    the address and repeat all of their work.
    """
    return F.explode(F.filter(F.array(u), lambda x: x.isNotNull()))


def _image_urls(img: DataFrame) -> DataFrame:
    """Candidate addresses of image rows that have their ``page_url``; null for other rows."""
    base = F.col("page_url")
    img = img.withColumn("_set", F.when(is_img(), media.pick_srcset(attr("srcset"))))
    img = img.withColumn("srcset_url", urls.resolve_url(base, F.col("_set"), upgrade=False))
    img = img.withColumn("src_url", F.when(is_img() & ~img_src().startswith("data:"), urls.resolve_url(base, img_src(), upgrade=False)))
    lazy = F.coalesce(*[
        F.when((attr(a) != "") & ~attr(a).startswith("data:"), attr(a))
        for a in ("data-src", "data-lazy-src", "data-original")
    ])
    img = img.withColumn("_lazy", F.when(is_img(), lazy))
    img = img.withColumn("lazy_url", urls.resolve_url(base, F.col("_lazy"), upgrade=False))
    for c in ("srcset_url", "src_url", "lazy_url"):
        img = img.withColumn(c, _usable(F.col(c)))
    return img.drop("_set", "_lazy")


def with_image_urls(nodes: DataFrame, page: DataFrame) -> DataFrame:
    """Image rows with their candidate addresses: best srcset entry, src, lazy attributes."""
    return _image_urls(nodes.filter(is_img()).join(page.select("page_id", "page_url"), "page_id"))


def asset_list(nodes: DataFrame, page: DataFrame, level: str = "standard") -> DataFrame:
    """EXT-28 and SET-07: what to load for a page, each address once, in page order.

    Images and other references are told apart by row, so that the nodes are worked out once.
    """
    if level == "standard":
        n = nodes.filter(node_tag().isin("img", "picture", "source")).withColumn(
            "_pic", dom.nearest(node_tag() == "picture", F.col("pre")))
        more = (node_tag() == "source") & (F.col("_pic") == F.col("parent")) & (attr("srcset") != "")
        ref, kind = media.pick_srcset(attr("srcset")), "image"
    else:
        n = nodes.filter(node_tag().isin("img", "link"))
        more = (node_tag() == "link") & (attr("rel") == "stylesheet") & (attr("href") != "")
        ref, kind = attr("href"), "stylesheet"
    n = n.withColumn("_more", F.coalesce(more, F.lit(False))).filter(is_img() | F.col("_more"))
    n = _image_urls(n.join(page.select("page_id", "page_url"), "page_id"))
    # The reference gets its own projection: resolving it reads it many times.
    n = n.withColumn("_ref", F.when(F.col("_more"), ref))
    n = n.withColumn("_ref_url", F.when(F.col("_more"), urls.resolve_url(F.col("page_url"), F.col("_ref"), upgrade=False)))
    return n.select(
        "page_id", "pre", _present(F.coalesce("srcset_url", "src_url", "lazy_url", "_ref_url")).alias("url"),
        F.when(F.col("_more"), kind).otherwise("image").alias("kind"),
    ).groupBy("page_id", "url").agg(F.min("pre").alias("pre"), F.min_by("kind", "pre").alias("kind"))


def asset_budget(asset: DataFrame) -> DataFrame:
    """EXT-30: which assets load: 2 MB each, 3 MB for the hero, 8 MB a page.

    ``asset`` has page_id, pre, size, is_hero and ok. Assets count in page order; the one that
    reaches the page budget is marked truncated and the ones after it are not loaded.
    """
    most = F.when(F.col("is_hero"), S.MAX_HERO_BYTES).otherwise(S.MAX_ASSET_BYTES)
    fits = F.col("ok") & (F.col("size") <= most)
    w = Window.partitionBy("page_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    d = asset.withColumn("_fits", fits).withColumn(
        "_sum", F.sum(F.when(F.col("_fits"), F.col("size")).otherwise(0)).over(w)
    )
    started = F.col("_sum") - F.when(F.col("_fits"), F.col("size")).otherwise(0) < S.MAX_TOTAL_ASSET_BYTES
    return (
        d.withColumn("loaded", F.col("_fits") & started)
        .withColumn("was_truncated", F.col("loaded") & (F.col("_sum") >= S.MAX_TOTAL_ASSET_BYTES))
        .withColumn("failed", ~F.col("_fits"))
        .drop("_fits", "_sum")
    )


def valid_asset_type(mime: Column) -> Column:
    """Error pages served in place of an asset do not count as loaded."""
    prefixes = "|".join(p.replace("+", r"\+") for p in media.ASSET_TYPES)
    return F.coalesce(F.lower(mime).rlike(f"^(?:{prefixes})"), F.lit(True))


def asset_fallbacks(nodes: DataFrame, page: DataFrame, fetch: DataFrame) -> DataFrame:
    """EXT-32: the address that loaded for each image: the chosen one, else its src, else the
    surrounding link to an image file on the same host.

    ``fetch`` has one row per address: ``url`` and ``ok``.
    """
    n = nodes.withColumn("_a", dom.nearest(node_tag() == "a", F.struct(F.col("pre").alias("pre"), attr("href").alias("href"))))
    img = with_image_urls(n, page).withColumn("first_url", F.coalesce("srcset_url", "src_url", "lazy_url"))
    img = img.withColumn("_link", F.when(
        F.col("_a.pre") == F.col("parent"), urls.resolve_url(F.col("page_url"), F.col("_a.href"), upgrade=False)))
    linked = (
        (urls.host(F.col("_link")) == urls.host(F.col("src_url"))) & (F.col("_link") != F.col("src_url"))
        & media.extension(F.col("_link")).isin(*media.IMAGE_EXTENSIONS)
    )
    img = img.withColumn("link_url", F.when(linked, F.col("_link")))
    tries = img.select(
        "page_id", "pre",
        F.posexplode(F.array("first_url", "src_url", "link_url")).alias("tier", "url"),
    ).filter(F.col("url").isNotNull())
    good = fetch.filter("ok").select("url").distinct()
    return tries.join(good, "url").groupBy("page_id", "pre").agg(
        F.min_by("url", "tier").alias("url"), F.min("tier").alias("tier")
    )


def rewrite_assets(nodes: DataFrame, page: DataFrame, stored: DataFrame) -> DataFrame:
    """EXT-31: images and stylesheets point at their stored copies; images without one go.

    ``stored`` has page_id, url and filename. An image matches by src, lazy src or any srcset
    entry, in that order.
    """
    img = nodes.filter(is_img() | (node_tag() == "link")).join(page.select("page_id", "page_url"), "page_id")
    base = F.col("page_url")
    plain = F.array(
        F.when(is_img(), img_src()).otherwise(attr("href")), F.when(is_img(), attr("data-src")),
    )
    entries = F.transform(media.srcset_candidates(F.when(is_img(), attr("srcset"))), lambda c: c["url"])
    refs = F.concat(plain, F.coalesce(entries, F.array().cast("array<string>")))
    tries = img.select("page_id", "pre", base, F.posexplode(refs).alias("_t", "_ref")).filter("_ref <> ''")
    tries = tries.withColumn("url", urls.resolve_url(base, F.col("_ref"), upgrade=False))
    found = tries.join(stored.select("page_id", "url", "filename"), ["page_id", "url"]).groupBy("page_id", "pre").agg(
        F.min_by("filename", "_t").alias("_file")
    )
    d = nodes.join(found, ["page_id", "pre"], "left")
    local = F.concat(F.lit(LOCAL), "_file")
    bare = dom.drop_attrs(["srcset", "sizes", "loading", "decoding", "data-src"])
    attrs = (
        F.when(is_img() & F.col("_file").isNotNull(), dom.set_attrs({"src": local}, bare))
        .when((node_tag() == "link") & F.col("_file").isNotNull(), dom.set_attrs({"href": local}))
        .when(is_img(), dom.drop_attrs(["srcset", "sizes"]))
        .otherwise(F.col("attrs"))
    )
    d = d.withColumn("_gone", (is_img() & F.col("_file").isNull() & ~img_src().startswith("data:"))
                     | ((node_tag() == "link") & (attr("rel") == "stylesheet") & F.col("_file").isNull()))
    d = d.withColumn("attrs", attrs).filter(~F.col("_gone"))
    return dom.prune(d, node_tag() == "source").select(*nodes.columns)


def asset_totals(asset: DataFrame) -> DataFrame:
    """AGG-10: bytes, truncation and resulting status per page."""
    return asset.groupBy("page_id").agg(
        F.coalesce(F.sum(F.when(F.col("loaded"), F.col("size"))), F.lit(0)).alias("total_size_bytes"),
        F.coalesce(F.bool_or("was_truncated"), F.lit(False)).alias("is_truncated"),
        F.when(F.bool_or("failed"), "partial").otherwise("cached").alias("fetch_status"),
    )


def shared_asset_dedup(asset: DataFrame) -> DataFrame:
    """AGG-15: one stored copy per address, against the bytes pages refer to."""
    one = asset.filter("loaded").groupBy(F.sha2("url", 256).alias("asset_key")).agg(
        F.max("size").alias("stored_bytes"), F.sum("size").alias("referenced_bytes"),
        F.count("*").alias("pages"),
    )
    return one
