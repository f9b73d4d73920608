"""The visible articles of an append-only event log that keeps growing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbena.operators.literature import last_events


def latest_versions(events: DataFrame) -> DataFrame:
    """The last event of each article so far, deletions included, as an aggregation that a stream carries on.

    Run it in update mode: a row comes out whenever an article's last event changes, and a consumer puts it in the place
    of the one before (a deletion takes the article away).  State is one row an article; an event older than the state's
    changes nothing, so order and repeats do not matter and no watermark is needed.
    """
    return last_events(events)


def apply_changes(visible: DataFrame, changes: DataFrame) -> DataFrame:
    """``visible`` after a batch of changed articles, for use in ``foreachBatch``."""
    keys = ["provider_id", "article_id"]
    kept = visible.join(changes.select(*keys), keys, "left_anti").select(*visible.columns)
    return kept.unionByName(changes.where(~F.col("is_deleted")).select(*visible.columns))
