"""Extraction payloads: tolerant parsing, segment merge, batch results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricebase.functions.skew import range_parts
from pricebase.functions.text import without_nul
from pricebase.session import written

# Document types and the attributes of a line.
DOCUMENT_TYPES = ("devis", "facture", "situation", "avenant", "indetermine")
TEXT_ATTRIBUTES = ("materiau", "profile", "dimensions", "finition", "marque", "localisation")
NUMBER_ATTRIBUTES = ("section_mm", "longueur_m", "epaisseur_mm")
BOOLEAN_ATTRIBUTES = ("fourniture_incluse",)
HEADER_TEXT = (
    "numero_document", "date_document", "client_nom", "client_code_postal", "client_commune",
    "chantier_objet", "chantier_code_postal", "chantier_commune",
)
HEADER_NUMBERS = ("total_ht", "tva_taux", "total_ttc")

LINE_SCHEMA = T.StructType(
    [
        T.StructField("ordre", T.IntegerType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("designation", T.StringType()),
        T.StructField("unite_brute", T.StringType()),
        T.StructField("quantite", T.DoubleType()),
        T.StructField("pu_ht", T.DoubleType()),
        T.StructField("total_ht", T.DoubleType()),
        T.StructField("est_titre", T.BooleanType()),
        # every attribute as text: a badly typed one is coerced or dropped, never fatal
        T.StructField("attributs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("confiance", T.DoubleType()),
    ]
)
PAYLOAD_SCHEMA = T.StructType(
    [
        T.StructField("type_document", T.StringType()),
        T.StructField("est_ts", T.BooleanType()),
        T.StructField("indice_ts", T.StringType()),
        *[T.StructField(c, T.StringType()) for c in HEADER_TEXT],
        *[T.StructField(c, T.DoubleType()) for c in HEADER_NUMBERS],
        T.StructField("lignes", T.ArrayType(LINE_SCHEMA)),
        T.StructField("remarques", T.StringType()),
        T.StructField("_corrupt", T.StringType()),
    ]
)


def json_body(text: Column) -> Column:
    """The outermost JSON object of an answer, without code fences or NUL characters."""


    def between_braces(t: Column) -> Column:
        first, from_end = F.locate("{", t), F.locate("}", F.reverse(t))
        length = F.length(t) - from_end + 2 - first
        return F.when((first > 0) & (from_end > 0) & (length > 1), F.substr(t, first, length))

    # one-element array: the text is cleaned once and bound to a lambda variable
    return F.get(F.transform(F.array(without_nul(text)), between_braces), F.lit(0))


def _payload_error(d: Column) -> Column:
    """Name of the first required part that is missing or wrong, NULL for a valid payload."""
    bad_line = F.exists(
        d["lignes"],
        lambda line: line["ordre"].isNull()
        | line["page"].isNull()
        | (F.coalesce(line["designation"], F.lit("")) == "")
        | ~F.coalesce(line["confiance"].between(0.0, 1.0), F.lit(False)),
    )
    return (
        F.when(d.isNull() | d["_corrupt"].isNotNull(), "json")
        .when(~F.coalesce(d["type_document"].isin(*DOCUMENT_TYPES), F.lit(False)), "type_document")
        .when(d["est_ts"].isNull(), "est_ts")
        .when(d["lignes"].isNull(), "lignes")
        .when(bad_line, "ligne")
    )


def parse_payloads(rows: DataFrame, text: str = "payload") -> DataFrame:
    """Adds document (struct) and error: a missing required field fails the document.

    The parsed value is unfolded from a one-element array, so that later filters on the error do
    not make the planner parse the text again.
    """
    parsed = F.from_json(
        json_body(F.col(text)),
        PAYLOAD_SCHEMA,
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"},
    )
    checked = F.transform(
        F.array(parsed), lambda d: F.struct(d.alias("document"), _payload_error(d).alias("error"))
    )
    return rows.select("*", F.inline(checked))


def quarantine(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("error").isNotNull())


def headers(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per valid payload."""
    names = ("type_document", "est_ts", "indice_ts", *HEADER_TEXT, *HEADER_NUMBERS, "remarques")
    return parsed.where(F.col("error").isNull()).select(
        *keys, *[F.col(f"document.{c}").alias(c) for c in names]
    )


def attribute(attributes: Column, name: str) -> Column:
    """A line attribute in its type, or NULL when it cannot be read."""
    value = F.try_element_at(attributes, F.lit(name))
    if name in NUMBER_ATTRIBUTES:
        return value.try_cast("double")
    if name in BOOLEAN_ATTRIBUTES:
        return F.when(value.isin("true", "false"), value == "true")
    return value


def payload_lines(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """The lines of valid payloads, unfolded, with their place (from 1) and typed attributes."""
    lines = (
        parsed.where(F.col("error").isNull())
        .select(*keys, F.posexplode("document.lignes").alias("_at", "_line"))
        .select(*keys, (F.col("_at") + 1).alias("position"), "_line.*")
    )
    return lines.withColumn("est_titre", F.coalesce("est_titre", F.lit(False))).withColumns(
        {
            f"attr_{name}": attribute(F.col("attributs"), name)
            for name in (*TEXT_ATTRIBUTES, *NUMBER_ATTRIBUTES, *BOOLEAN_ATTRIBUTES)
        }
    )


def merged_headers(segments: DataFrame) -> DataFrame:
    """Headers of the parts of one document -> one header per document.

    ``segments``: document_key, segment and the header columns. First non-null field in segment
    order, largest totals, first determined type, remarks joined in order; the extra-work fields
    come from the first segment. Remarks are short texts, one per segment.
    """

    def first(column: str, condition: Column | None = None) -> Column:
        known = F.col(column).isNotNull() if condition is None else condition
        return F.min_by(column, F.when(known, F.col("segment"))).alias(column)

    determined = first("type_document", F.col("type_document") != "indetermine")
    return (
        segments.groupBy("document_key")
        .agg(
            determined.alias("type_document"),
            F.min_by(F.struct("est_ts", "indice_ts"), "segment").alias("_first"),
            *[first(c) for c in (*HEADER_TEXT, "tva_taux")],
            F.max("total_ht").alias("total_ht"),
            F.max("total_ttc").alias("total_ttc"),
            F.array_sort(
                F.collect_list(
                    F.when(F.col("remarques") != "", F.struct("segment", "remarques"))
                )
            ).alias("_remarks"),
        )
        .withColumn("type_document", F.coalesce("type_document", F.lit("indetermine")))
        .withColumn("remarques", F.nullif(F.array_join("_remarks.remarques", " | "), F.lit("")))
        .select("*", "_first.est_ts", "_first.indice_ts")
        .drop("_first", "_remarks")
    )


def merged_lines(lines: DataFrame) -> DataFrame:
    """Lines of all parts renumbered 1..n in segment order.

    The number is the line's place in its segment plus the size of the segments before it. Ranges of
    (document, segment) are numbered apart and get what earlier ranges hold of their first document, so a
    document of any length is never sorted in one task and a line moves once. ``lines``: document_key,
    segment, position; they are written out once, so that the answers they come from are parsed once.
    """
    lines = written(lines.dropna(subset=["document_key", "segment"]))
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = lines.withColumn("_part", range_parts(lines, ["document_key", "segment"], parts))
    earlier = Window.partitionBy("document_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = placed.groupBy("document_key", "_part").agg(F.count(F.lit(1)).alias("_size"))
    # few documents lie in several ranges; written, so that Spark knows how few
    offsets = written(
        held.select("document_key", "_part", F.sum("_size").over(earlier).alias("_offset")).dropna(subset=["_offset"])
    )
    inside = Window.partitionBy("document_key", "_part").orderBy("segment")
    before = F.rank().over(inside).cast("bigint") - 1 + F.coalesce("_offset", F.lit(0))
    kept = [c for c in lines.columns if c not in ("document_key", "segment")]
    return (
        placed.join(offsets, ["document_key", "_part"], "left")
        .withColumn("ord", F.col("position") + before)
        .select("document_key", "segment", *kept, "ord")
    )


def read_batch_answers(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a batch answer file; ``_corrupt`` holds what is not JSON of this shape."""
    schema = (
        "custom_id string, error struct<message:string>, response struct<status_code:int,"
        " body:struct<choices:array<struct<message:struct<content:string>>>>>, _corrupt string"
    )
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    lines = spark.read.text(path).where(F.trim("value") != "")
    answers = lines.select("value", F.from_json("value", schema, options).alias("a"))
    broken = F.col("a").isNull() | F.col("a._corrupt").isNotNull()
    fields = [F.col(f"a.{c}").alias(c) for c in ("custom_id", "error", "response")]
    return answers.select(*fields, F.when(broken, F.col("value")).alias("_corrupt"))


def read_batch_results(spark: SparkSession, path: str) -> DataFrame:
    """Batch answers (JSON lines): import_id, content or error. See ``batch_quarantine``."""
    return batch_results(read_batch_answers(spark, path))


def batch_quarantine(answers: DataFrame) -> DataFrame:
    """Lines that no import can be found for: line (if kept) and reason (``json`` or ``custom_id``)."""
    line = F.col("_corrupt") if "_corrupt" in answers.columns else F.lit(None).cast("string")
    return answers.where(line.isNotNull() | F.col("custom_id").isNull()).select(
        line.alias("line"), F.when(line.isNotNull(), "json").otherwise("custom_id").alias("reason")
    )


def batch_results(answers: DataFrame) -> DataFrame:
    """One row per readable answer of a named import."""
    answers = answers.where(F.col("custom_id").isNotNull())
    if "_corrupt" in answers.columns:
        answers = answers.where(F.col("_corrupt").isNull())
    content = F.nullif(F.get("response.body.choices", F.lit(0))["message"]["content"], F.lit(""))
    return answers.select(
        F.col("custom_id").alias("import_id"),
        content.alias("content"),
        F.when(
            content.isNull(),
            F.coalesce(
                "error.message",
                F.concat(
                    F.lit("Réponse vide (statut HTTP "),
                    F.coalesce(F.col("response.status_code").cast("string"), F.lit("?")),
                    F.lit(")."),
                ),
            ),
        ).alias("error"),
    )


def results_to_insert(results: DataFrame, ledger: DataFrame) -> DataFrame:
    """Answers of known imports that are not inserted yet."""
    waiting = ledger.where(F.col("status") != "insere").select(
        F.col("import_id").cast("string").alias("import_id"), "file_name", "file_hash"
    )
    return results.join(waiting, "import_id")
