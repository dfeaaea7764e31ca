"""Image, srcset and asset column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from feedloom.functions import urls

# Sizes, words, hosts and patterns the image rules test for.
SRCSET_TARGET_WIDTH = 1000
SRCSET_MAX_WIDTH = 1500
DENSITY_WIDTH = 600
TRACKING_IMAGE_HOSTS = (
    "sb.scorecardresearch.com", "pixel.quantserve.com", "b.scorecardresearch.com",
)
NON_CONTENT_HOST_PREFIXES = ("tracking.", "pixel.", "beacon.", "analytics.")
NON_CONTENT_PATHS = ("/eventhandler", "/pixel", "/beacon", "/track/")
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "webp", "avif")
LAZY_IMAGE_EXTENSIONS = IMAGE_EXTENSIONS + ("bmp", "tiff")
IDENTITY_PARAMS = ("id", "uuid", "p", "attachment_id", "url")
GENERIC_FILENAMES = (
    "image.jpg", "image.jpeg", "image.png", "image.webp", "photo.jpg", "photo.jpeg",
    "jpeg", "jpg", "png", "webp", "gif", "avif",
    "large", "small", "medium", "thumbnail", "thumb", "original", "full", "default",
)
MIME_EXTENSIONS = {
    "image/jpeg": "jpg", "image/jpg": "jpg", "image/png": "png", "image/gif": "gif",
    "image/webp": "webp", "image/svg+xml": "svg", "image/avif": "avif", "image/heic": "heic",
    "image/heif": "heif", "image/tiff": "tiff", "image/bmp": "bmp", "image/ico": "ico",
    "image/x-icon": "ico", "image/vnd.microsoft.icon": "ico", "text/css": "css",
    "application/font-woff": "woff", "font/woff": "woff", "application/font-woff2": "woff2",
    "font/woff2": "woff2", "font/ttf": "ttf", "application/x-font-ttf": "ttf",
    "font/otf": "otf", "application/x-font-otf": "otf",
}
ASSET_TYPES = (
    "image/", "text/css", "font/", "application/font", "application/x-font",
    "application/octet-stream",
)


def to_int(s: Column) -> Column:
    """Integer attribute value of any size; null for anything else, such as ``50%`` or ``auto``."""
    return F.when(s.rlike(r"^[+-]?\d+$"), F.coalesce(s.try_cast("bigint"), F.lit(2**63 - 1)))


def first_image_src(html: Column) -> Column:
    """FN-13: first image address in a fragment; embedded data does not count."""
    src = F.regexp_extract(html, r"""(?i)<img\s[^>]*?src\s*=\s*["']([^"']+)["']""", 1)
    return F.when((src != "") & ~src.startswith("data:"), src)


def parse_srcset(srcset: Column) -> Column:
    """FN-17: srcset entries. A comma separates only after a width or density, or before a
    new address, so commas inside addresses survive."""
    marked = F.split(srcset, r"(?<=[wx])\s*,|,(?=\s*(?i:https?://|//|/|data:))")
    return F.filter(F.transform(marked, lambda e: F.trim(e)), lambda e: e != "")


def srcset_candidates(srcset: Column) -> Column:
    """Entries as (url, width): ``w`` is a width, ``x`` a multiple of 600, anything else 0."""

    def entry(e: Column) -> Column:
        parts = F.filter(F.split(e, r"\s+"), lambda x: x != "")
        last = F.lower(F.element_at(parts, -1))
        width = (
            F.when(F.size(parts) < 2, F.lit(0))
            .when(last.rlike(r"^\d+w$"), F.coalesce(F.regexp_replace(last, "w$", "").try_cast("bigint"), F.lit(2**63 - 1)))
            .when(last.rlike(r"^\d+(\.\d+)?x$"),
                  (F.regexp_replace(last, "x$", "").cast("double") * DENSITY_WIDTH).try_cast("bigint"))
            .otherwise(F.lit(0).cast("bigint"))
        )
        return F.struct(F.element_at(parts, 1).alias("url"), width.alias("width"))

    return F.filter(
        F.transform(parse_srcset(srcset), entry), lambda c: ~c["url"].startswith("data:")
    )


def pick_srcset(srcset: Column) -> Column:
    """WIN-14: the smallest width in the target range, else the largest below it, else the
    smallest; without widths the first entry."""
    c = F.transform(
        srcset_candidates(srcset),
        lambda x, i: F.struct(
            F.when(x["width"] <= 0, F.lit(3))
            .when(x["width"].between(SRCSET_TARGET_WIDTH, SRCSET_MAX_WIDTH), F.lit(0))
            .when(x["width"] < SRCSET_TARGET_WIDTH, F.lit(1))
            .otherwise(F.lit(2)).alias("class"),
            F.when(x["width"] < SRCSET_TARGET_WIDTH, -x["width"]).otherwise(x["width"]).alias("w"),
            i.alias("i"),
            x["url"].alias("url"),
        ),
    )
    return F.array_min(c)["url"]


def is_placeholder_image(u: Column) -> Column:
    """FLT-17: placeholder pictures and tracking pixels."""
    p = F.lower(urls.path(u))
    return (
        p.rlike(r"placeholder|lazyload-fallback|spacer|/pixel\.(?:gif|png)$|/blank\.gif$")
        | urls.host(u).isin(*TRACKING_IMAGE_HOSTS)
    )


def is_non_content_image(src: Column, width: Column, height: Column, max_dim: int = 30) -> Column:
    """EXT-04 predicate: tiny declared size, or a tracking host or path."""
    tiny = width.between(1, max_dim) | (
        ~F.coalesce(width.between(1, max_dim), F.lit(False)) & height.between(1, max_dim)
    )
    prefixes = "|".join(h.replace(".", r"\.") for h in NON_CONTENT_HOST_PREFIXES)
    tracker = urls.host(src).rlike(f"^(?:{prefixes})") | F.lower(urls.path(src)).rlike(
        "|".join(NON_CONTENT_PATHS)
    )
    return F.coalesce(tiny, F.lit(False)) | F.coalesce((src != "") & tracker, F.lit(False))


def image_dedup_key(src: Column) -> Column:
    """FN-18: address without size suffix and trailing variant number."""
    return F.regexp_replace(src, r"-\d+x\d+(-\d+)?", "")


def base_path_key(src: Column) -> Column:
    """Scheme, host and path, plus the query parameters that identify a picture.

    Null for relative and embedded addresses: those are only compared as they stand.
    """
    pairs = F.filter(
        F.split(urls.query(src), "&"),
        lambda p: F.lower(F.substring_index(p, "=", 1)).isin(*IDENTITY_PARAMS) & p.contains("="),
    )
    base = F.concat(
        F.regexp_extract(src, "^([^:/?#]+):", 1), F.lit("://"),
        F.regexp_replace(urls.authority(src), r"^.*@|:\d*$", ""), urls.path(src),
    )
    suffix = F.when(
        F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(pairs), "&"))
    ).otherwise(F.lit(""))
    absolute = (urls.scheme(src) != "") & (urls.authority(src) != "")
    return F.when(absolute, F.concat(base, suffix))


def host_file_key(src: Column) -> Column:
    """Host and file name; null for generic names and for relative addresses.

    With exactly two path segments the first one identifies the picture and is kept.
    """
    segs = F.filter(F.split(urls.path(src), "/"), lambda s: s != "")
    name = F.element_at(F.when(F.size(segs) > 0, segs), -1)
    generic = F.lower(name).isin(*GENERIC_FILENAMES) | F.lower(name).rlike(r"^\d+x\d*\.")
    bare_host = F.regexp_replace(urls.authority(src), r"^.*@|:\d*$", "")
    key = F.when(
        F.size(segs) == 2, F.concat_ws("/", bare_host, F.element_at(segs, 1), name)
    ).otherwise(F.concat_ws("/", bare_host, name))
    usable = (urls.scheme(src) != "") & (bare_host != "") & name.isNotNull() & ~generic
    return F.when(usable, key)


def extension(u: Column) -> Column:
    """Lower-cased file extension of the last path segment, empty when none."""
    last = F.substring_index(urls.path(u), "/", -1)
    return F.lower(F.regexp_extract(last, r"[^.]\.([^.]+)$", 1))


def asset_filename(u: Column, mime: Column) -> Column:
    """FN-19: digest of the address plus an extension from path, else type, else ``bin``."""
    last = F.substring_index(urls.path(u), "/", -1)
    ext = F.nullif(F.regexp_extract(last, r"[^.]\.([^.]+)$", 1), F.lit(""))
    kind = F.lower(F.trim(F.substring_index(mime, ";", 1)))
    table = F.create_map(*[F.lit(x) for kv in MIME_EXTENSIONS.items() for x in kv])
    return F.concat(
        F.sha2(u, 256), F.lit("."), F.coalesce(ext, F.try_element_at(table, kind), F.lit("bin"))
    )


def text_segments(s: Column) -> Column:
    """FN-25: lower-cased segments for whole-word matching."""
    return F.filter(F.split(F.lower(s), r"[_\-./ ?&=]"), lambda x: x != "")


def css_font_urls(css: Column) -> Column:
    """EXT-29: addresses inside ``@font-face`` blocks."""
    pattern = r"""(?s)@font-face\s*\{[^}]*url\(\s*['"]?([^'")]+)['"]?\s*\)"""
    return F.regexp_extract_all(css, F.lit(pattern), F.lit(1))
