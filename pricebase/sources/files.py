"""Inventory of the files to import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricebase.functions.text import ACCENTED, PLAIN

# Accepted extensions.
EXTENSIONS = ("pdf", "xls", "xlsx", "ods")


def extension(name: Column) -> Column:
    return F.lower(F.substring_index(name, ".", -1))


def storage_key(file_hash: Column, name: Column) -> Column:
    """ASCII-only key: accents dropped, other characters to single underscores."""
    plain = F.translate(name, ACCENTED + ACCENTED.upper(), PLAIN + PLAIN.upper())
    safe = F.regexp_replace(F.regexp_replace(plain, "[^A-Za-z0-9._-]", "_"), "_+", "_")
    return F.concat(F.lit("devis/"), F.substring(file_hash, 1, 12), F.lit("/"), safe)


def pdf_pages(content: Column) -> Column:
    """Estimated page count: page objects in the raw bytes."""
    return F.regexp_count(F.decode(content, "ISO-8859-1"), F.lit(r"/Type\s*/Page[^s]"))


def describe_files(rows: DataFrame) -> DataFrame:
    """file_name and content -> hash, size, extension, acceptance, page count, storage key."""
    hash_ = F.sha2("content", 256)
    ext = extension(F.col("file_name"))
    return rows.select(
        "file_name",
        hash_.alias("file_hash"),
        F.octet_length("content").cast("bigint").alias("size"),
        ext.alias("extension"),
        ext.isin(*EXTENSIONS).alias("accepted"),
        F.when(ext == "pdf", pdf_pages(F.col("content"))).alias("pages"),
        storage_key(hash_, F.col("file_name")).alias("storage_key"),
    )


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Every file below a folder, read as binary and described in one pass."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return describe_files(
        files.select(F.substring_index("path", "/", -1).alias("file_name"), "content")
    )


def deduplicate(files: DataFrame, documents: DataFrame) -> DataFrame:
    """Status of each file: 'doublon' when its content is known or repeats an earlier file.

    ``files``: file_name, file_hash; ``documents``: file_hash, document_id.
    """
    known = documents.groupBy("file_hash").agg(F.min("document_id").alias("document_id"))
    first = files.groupBy("file_hash").agg(F.min("file_name").alias("_first"))
    return (
        files.join(first, "file_hash")
        .join(known, "file_hash", "left")
        .withColumn(
            "status",
            F.when(
                F.col("document_id").isNotNull() | (F.col("file_name") != F.col("_first")),
                "doublon",
            ).otherwise("en_attente"),
        )
        .drop("_first")
    )
