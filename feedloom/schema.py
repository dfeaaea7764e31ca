"""Table schemas and fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Well-known ids, statuses and limits that results depend on.
SAVED_PAGES_ID = "00000000-0000-0000-0000-000000000001"
READABLE = ("cached", "partial")
UNCACHED = ("pending", "fetching", "failed")
STATUS_RANK = {"cached": 4, "partial": 3, "pending": 2, "fetching": 1, "failed": 0}
MAX_SOURCES = 25
DEFAULT_ARTICLE_LIMIT = 25
FULL_LEVEL_LIMIT = 10
MAX_AUTO_RETRIES = 2
VISIBLE_ARTICLES = 5
STALE_AFTER = "INTERVAL 1 HOUR"
MIN_CONTENT_CHARS = 50
MIN_CONTENT_WORDS = 50
RECENTLY_VERIFIED_DAYS = 60
STALE_FEED_MONTHS = 6
MAX_ASSET_BYTES = 2_000_000
MAX_HERO_BYTES = 3_000_000
MAX_TOTAL_ASSET_BYTES = 8_000_000

SOURCE = """
    id STRING, title STRING, feed_url STRING, site_url STRING, icon_url STRING,
    added_at TIMESTAMP, last_fetched_at TIMESTAMP, fetch_frequency STRING,
    fetch_status STRING, cache_level STRING, appearance_mode STRING, layout STRING,
    home_layout STRING, is_collapsed BOOLEAN, sort_order INT
"""

ARTICLE = """
    id STRING, source_id STRING, title STRING, article_url STRING,
    published_at TIMESTAMP, added_at TIMESTAMP, thumbnail_url STRING,
    cached_at TIMESTAMP, fetch_status STRING, is_read BOOLEAN, is_saved BOOLEAN,
    saved_at TIMESTAMP, original_source_name STRING, original_source_icon_url STRING,
    cache_size_bytes INT, last_http_status INT, etag STRING, last_modified STRING,
    retry_count INT, reading_minutes INT, rss_content_html STRING
"""

CACHED_PAGE = """
    article_id STRING, html_path STRING, asset_manifest ARRAY<STRING>,
    cached_at TIMESTAMP, total_size_bytes BIGINT, is_truncated BOOLEAN,
    cache_level_used STRING
"""

FEED_ITEM = """
    feed_url STRING, pos INT, title STRING, url STRING, published_at TIMESTAMP,
    thumbnail_url STRING, source_name STRING, content_html STRING
"""

DIRECTORY_FEED = """
    id STRING, name STRING, feedURL STRING, siteURL STRING, description STRING,
    category STRING, country STRING, tags ARRAY<STRING>, lastVerified DATE
"""

RAW_FEED = """
    name STRING, feed_url STRING, description STRING, category STRING,
    country STRING, site_url STRING
"""

FETCH_LOG = """
    url STRING, final_url STRING, status INT, content_type STRING, body STRING,
    etag STRING, last_modified STRING, attempt INT, fetched_at TIMESTAMP
"""


def columns(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(",")]


def conform(df: DataFrame, schema: str) -> DataFrame:
    """Bring an older table version to the current schema: missing columns become null."""
    from pyspark.sql.types import _parse_datatype_string

    wanted = _parse_datatype_string(schema)
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in wanted.fields
        ]
    )


def newest(prefix: str = "") -> "F.Column":
    """The standard ordering moment of an article."""
    return F.coalesce(F.col(prefix + "published_at"), F.col(prefix + "added_at"))
