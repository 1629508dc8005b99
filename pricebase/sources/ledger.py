"""The import ledger: latest state per file, stuck imports, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States, those still in progress, and the delay after which they are stuck.
STATES = ("en_attente", "extraction", "extrait", "insere", "erreur", "doublon")
IN_PROGRESS = ("en_attente", "extraction", "extrait")
STUCK_AFTER = "INTERVAL 30 MINUTES"
LISTED = 200


def latest_states(events: DataFrame) -> DataFrame:
    """Event log (file, state, ts, event_id) -> latest state of each file."""
    last = F.max(F.struct("ts", "event_id", "state")).alias("_l")
    first = F.min("ts").alias("created_at")
    return (
        events.groupBy("file")
        .agg(last, first, F.count(F.lit(1)).alias("n_events"))
        .select(
            "file",
            F.col("_l.state").alias("status"),
            "created_at",
            F.col("_l.ts").alias("updated_at"),
            "n_events",
        )
    )


def is_stuck(now: Column) -> Column:
    return F.col("status").isin(*IN_PROGRESS) & (F.col("updated_at") < now - F.expr(STUCK_AFTER))


def import_stats(ledger: DataFrame, now: Column | None = None) -> DataFrame:
    """Inserted, failed or stuck, duplicate and total imports."""
    at = F.current_timestamp() if now is None else now
    return ledger.agg(
        F.count_if(F.col("status") == "insere").alias("n_inserted"),
        F.count_if((F.col("status") == "erreur") | is_stuck(at)).alias("n_failed"),
        F.count_if(F.col("status") == "doublon").alias("n_duplicates"),
        F.count(F.lit(1)).alias("n_imports"),
    )


def import_list(ledger: DataFrame, limit: int = LISTED) -> DataFrame:
    return ledger.orderBy(F.col("created_at").desc(), F.col("file")).limit(limit)


def retry_set(ledger: DataFrame, inserted: DataFrame, now: Column | None = None) -> DataFrame:
    """Failed or stuck imports with a content hash that was never inserted; their row is reused."""
    at = F.current_timestamp() if now is None else now
    return ledger.where(
        ((F.col("status") == "erreur") | is_stuck(at)) & F.col("file_hash").isNotNull()
    ).join(inserted.select("file_hash"), "file_hash", "left_anti")
