"""The directory audit as one job: validate, retry, judge, publish and report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedloom.operators import directory as D
from feedloom.session import materialize
from feedloom.sources import tables


def run_audit(directory: DataFrame, log: DataFrame, signal: DataFrame, today: Column) -> dict[str, DataFrame]:
    """``log`` holds up to two attempts per feed address, ``signal`` page facts per feed."""
    due = directory.filter(~D.is_recently_verified(F.col("last_verified"), today)).select(
        F.col("feed_url").alias("url")).distinct()
    checked = log.join(due, "url", "left_semi")
    # Checked once: every fact below reads the parsed documents.
    checked = materialize(D.feed_issue(checked))
    first = D.validated_facts(checked.filter("attempt = 1"))
    retry = D.validated_facts(checked.filter("attempt = 2"))
    audited = D.audit(directory, first, retry, D.feed_quality(signal), today)
    kept = audited.filter("kept")
    return {
        "audited": audited,
        "published": tables.published_feeds(kept),
        "stamped": D.stamp_verified(directory, audited.filter("verified_now"), today),
        "report": D.directory_report(audited),
    }
