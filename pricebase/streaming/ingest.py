"""Incremental ingest: extraction JSON files in, controlled and normalised documents out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pricebase.operators.normalize import normalize_units, recover_dates, resolve_zones
from pricebase.operators.quality import document_controls, line_controls
from pricebase.sources import dims
from pricebase.sources.payloads import headers, parse_payloads, payload_lines, quarantine

INPUT_SCHEMA = "file_name string, file_hash string, payload string"
KEYS = ["file_hash"]


def prepare_batch(batch: DataFrame) -> dict[str, DataFrame]:
    """One micro-batch of raw answers -> documents, lines and quarantined rows."""
    spark = batch.sparkSession
    parsed = parse_payloads(batch)
    raw_lines = payload_lines(parsed, KEYS).select(
        F.col("file_hash").alias("document_id"),
        F.col("ordre").alias("ord"),
        "page",
        "designation",
        F.col("unite_brute").alias("unit_raw"),
        F.col("quantite").cast("decimal(14,3)").alias("quantity"),
        F.col("pu_ht").cast("decimal(14,4)").alias("unit_price"),
        F.col("total_ht").cast("decimal(14,2)").alias("total"),
        F.col("est_titre").alias("is_title"),
        "attributs",
        F.col("confiance").alias("confidence"),
    )
    lines = normalize_units(line_controls(raw_lines), dims.unit_aliases(spark))
    head = headers(parsed, [*KEYS, "file_name"]).select(
        F.col("file_hash").alias("document_id"),
        "file_hash",
        "file_name",
        F.col("type_document").alias("type"),
        F.col("est_ts").alias("is_extra"),
        F.col("numero_document").alias("number"),
        F.col("date_document").alias("date_text"),
        F.col("client_nom").alias("client_name"),
        F.col("client_code_postal").alias("client_postal_code"),
        F.col("chantier_objet").alias("site_title"),
        F.col("chantier_code_postal").alias("site_postal_code"),
        F.col("total_ht").alias("total"),
        F.col("tva_taux").alias("vat"),
        F.col("total_ttc").alias("total_vat"),
    )
    controls = document_controls(lines, head)
    documents = recover_dates(resolve_zones(head, dims.zone_towns(spark))).join(
        controls, "document_id"
    )
    return {"documents": documents, "lines": lines, "quarantine": quarantine(parsed)}


def new_files(batch: DataFrame, known_hashes: DataFrame | None) -> DataFrame:
    """Rows of contents never seen: once per hash inside the batch, none already stored."""
    once = batch.dropDuplicates(["file_hash"])
    if known_hashes is None:
        return once
    return once.join(known_hashes, "file_hash", "left_anti")


def _stored_hashes(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """Hashes of earlier batches (a replayed batch must not see its own rows)."""
    try:
        stored = spark.read.parquet(path)
    except Exception as error:  # the first batch finds no table yet
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        return None
    return stored.where(F.col("batch") != batch_id).select("file_hash")


def batch_writer(output: str) -> Callable[[DataFrame, int], None]:
    """Sink of the stream. Each batch owns a partition and overwrites it, so a replay is harmless."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = _stored_hashes(spark, f"{output}/documents", batch_id)
        fresh = new_files(batch, known).persist()
        for name, rows in prepare_batch(fresh).items():
            (
                rows.withColumn("batch", F.lit(batch_id))
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy("batch")
                .parquet(f"{output}/{name}")
            )
        fresh.unpersist()

    return write


def start_ingest(
    spark: SparkSession, source: str, output: str, checkpoint: str, files_per_batch: int = 1000
) -> StreamingQuery:
    """Processes everything that has arrived, then stops; run again to resume."""
    answers = (
        spark.readStream.schema(INPUT_SCHEMA)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(source)
    )
    return (
        answers.writeStream.foreachBatch(batch_writer(output))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ledger_stream(events: DataFrame) -> DataFrame:
    """Latest state per file from a stream of ledger events (file, state, ts, event_id)."""
    last = F.max(F.struct("ts", "event_id", "state")).alias("last")
    return events.groupBy("file").agg(last).select(
        "file", F.col("last.state").alias("status"), F.col("last.ts").alias("updated_at")
    )


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Events per state and window, finished once later than the watermark."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "state")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), "state", "n")
    )
