"""Inputs of the checks that the model tables do not carry, derived from the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricebase.sources.fixtures import Model, client_name

NOW = "2024-01-30 12:00:00"
LAST_YEAR = 2027


def k(modulus: int) -> Column:
    return F.pmod(F.col("line_key"), F.lit(modulus))


def _pick(values: tuple, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def raw_unit_lines(m: Model) -> DataFrame:
    raw = ("M2 ", "m²", "cm2", "T", "Ens", "ENSEMBLE", "xyz", None, "U", "Mètre Carré", "fft", "Kg")
    return m.lines().select("line_id", "quantity", _pick(raw, k(12)).alias("unit_raw"))


def raw_zone_documents(m: Model) -> DataFrame:
    site = ("06000", "83600 ", "06450", "06999", "83999", "75001", None, "83100")
    client = ("83000", "06420", "13001", None, "06410")
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    return m.table("orders").select(
        key.alias("document_id"),
        _pick(site, F.pmod(key, F.lit(8))).alias("site_postal_code"),
        _pick(client, F.pmod(customer, F.lit(5))).alias("client_postal_code"),
    )


def raw_date_documents(m: Model) -> DataFrame:
    """Dates written in many ways (25 years later, so that most years are plausible)."""
    key = F.col("o_orderkey")
    date = F.add_months(F.col("o_orderdate").cast("date"), 300)
    months = ("janvier", "fév", "mars", "avril", "mai", "juin", "juil", "août", "sept", "octobre",
              "nov", "décembre")
    month = _pick(months, F.month(date) - 1)
    day, year = F.day(date).cast("string"), F.year(date).cast("string")

    def shape(pattern: str) -> Column:
        return F.date_format(date, pattern)

    text = (
        F.when(F.pmod(key, F.lit(10)) == 0, F.concat(F.lit("FREJUS le "), shape("dd/MM/yyyy")))
        .when(F.pmod(key, F.lit(10)) == 1, F.concat(day, F.lit("er "), month, F.lit(" "), year))
        .when(F.pmod(key, F.lit(10)) == 2, F.concat(F.lit("Le "), day, F.lit(" "), F.upper(month), F.lit(". "), year))
        .when(F.pmod(key, F.lit(10)) == 3, F.concat(month, F.lit(" "), year))
        .when(F.pmod(key, F.lit(10)) == 4, shape("yyyy-MM"))
        .when(F.pmod(key, F.lit(10)) == 5, shape("dd.MM.yy"))
        .when(F.pmod(key, F.lit(10)) == 6, shape("yyyy-MM-dd"))
        .when(F.pmod(key, F.lit(10)) == 7, F.lit("31/02/2025"))
        .when(F.pmod(key, F.lit(10)) == 8, F.concat(F.lit("N "), shape("dd/MM/1999")))
    )
    file = (
        F.when(F.pmod(key, F.lit(4)) == 0, F.concat(F.lit("DPGF_ord_"), shape("ddMMyy"), F.lit("_rev00.pdf")))
        .when(F.pmod(key, F.lit(4)) == 1, F.concat(F.lit("Trame lot2 "), shape("dd-MM-yy"), F.lit(".xlsx")))
        .when(F.pmod(key, F.lit(4)) == 2, F.concat(shape("yyyy MM dd"), F.lit(" OS.pdf")))
        .otherwise(F.concat(F.lit("DEVIS N"), key.cast("string"), F.lit(".pdf")))
    )
    return m.table("orders").select(
        key.alias("document_id"), text.alias("date_text"), file.alias("file_name")
    )


def printed_lines(m: Model) -> DataFrame:
    """Lines whose printed total drifts from quantity x price by up to the tolerance."""
    drift = F.lit(1.0) - (F.lit(1.0) - F.col("confidence")) / 20.0
    total = (F.floor(F.col("total").cast("double") * drift * 100.0 + 0.5) / 100.0).cast("decimal(14,2)")
    return m.lines().withColumn("amount", F.col("total")).withColumn(
        "total", F.when(k(53) != 7, total)
    )


def printed_documents(m: Model) -> DataFrame:
    totals = m.lines().groupBy("document_id").agg(F.sum("total").cast("decimal(14,2)").alias("total"))
    types = m.documents(zoned=False).select("document_id", "type", "is_extra")
    gross = F.when(F.col("is_extra"), F.col("total") * 1.2).otherwise(F.col("total") * 1.1)
    return totals.join(types, "document_id").select(
        "document_id",
        "type",
        "total",
        F.lit(20.0).alias("vat"),
        gross.cast("double").alias("total_vat"),
    )


def raw_client_names(m: Model) -> DataFrame:
    """Names as printed: right, upper-case alias, misspelt, or of a client nobody knows yet."""
    key = F.col("o_custkey")
    name = client_name(key)
    n = F.pmod(F.col("o_orderkey"), F.lit(4))
    printed = (
        F.when(F.pmod(key, F.lit(10)) == 3, F.concat(F.lit("Agence "), client_name(key + 1000003 * 17 + 5)))
        .when(n == 0, name)
        .when(n == 1, F.upper(name))
        .when(n == 2, F.concat(name, F.lit("s")))
        .otherwise(F.replace(name, F.lit("e"), F.lit("é")))
    )
    return m.table("orders").select(printed.alias("raw_name"))


def known_clients(m: Model) -> DataFrame:
    return m.clients().where(F.pmod(F.col("client_id"), F.lit(10)) != 3)


def known_aliases(m: Model) -> DataFrame:
    return known_clients(m).select(F.upper("name").alias("alias"), "client_id")


def gestures(m: Model) -> DataFrame:
    """Every event is a gesture of a user on the links of one document."""
    events = m.table("events").select(
        F.col("event_id").alias("document_id"), "event_id", "ts", "user_id", "event_type"
    )
    links = m.linked_lines().select("link_id", "line_id", "document_id", "item_id", "ord", "score", "method", "validated", "validated_by", "validated_on")
    return links.join(events, "document_id").select(
        "link_id",
        "line_id",
        "item_id",
        "ord",
        "score",
        "event_id",
        "event_type",
        F.concat(F.lit("g"), F.col("event_id").cast("string")).alias("batch_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("actor"),
        F.col("user_id"),
        F.col("ts").alias("at"),
    )


def validation_commands(m: Model) -> DataFrame:
    return gestures(m).where(F.col("event_type").isin("purchase", "view")).select(
        "link_id", "batch_id", "actor", "at",
        F.when(F.col("event_type") == "view", F.col("user_id")).alias("new_item_id"),
    )


def attach_commands(m: Model) -> DataFrame:
    """Users attach all lines of the documents they signed up for, linked or not."""
    events = m.table("events").where(F.col("event_type") == "signup").select(
        F.col("event_id").alias("document_id"),
        F.col("user_id").alias("target_item_id"),
        F.concat(F.lit("g"), F.col("event_id").cast("string")).alias("batch_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("actor"),
        F.col("ts").alias("at"),
    )
    return m.lines().select("line_id", "document_id").join(events, "document_id")


def journal(m: Model) -> DataFrame:
    """A journal with one gesture per user and day; before-images are missing for new links."""
    g = gestures(m)
    action = F.when(F.col("event_type") == "signup", "creer").when(
        F.col("event_type") == "purchase", "valider"
    ).otherwise("modifier")
    before = F.when(
        F.col("event_type") != "signup",
        F.struct(
            (F.col("item_id") + 1).alias("item_id"),
            F.lit(0.5).cast("decimal(4,3)").alias("score"),
            F.lit("regle").alias("method"),
            F.lit(False).alias("validated"),
            F.lit(None).cast("string").alias("validated_by"),
            F.lit(None).cast("date").alias("validated_on"),
        ),
    )
    return g.select(
        (F.col("event_id") * 100 + F.col("ord")).alias("seq"),
        F.concat(F.col("actor"), F.lit("-"), F.col("at").cast("date").cast("string")).alias("batch_id"),
        action.alias("action"),
        "link_id",
        before.alias("before"),
        F.when(F.col("event_type") == "signup", F.col("item_id")).alias("created_item_id"),
        F.lit(None).cast("bigint").alias("merged_item_id"),
        "actor",
        "at",
        F.when(F.col("event_type") == "error", F.col("at")).cast("timestamp").alias("undone_at"),
    )


def proposals(m: Model) -> DataFrame:
    """Open and decided merge proposals between items sold by the same supplier number."""
    pair = m.table("lineitem").where(F.col("l_partkey") != F.col("l_suppkey"))
    return (
        pair.groupBy(
            F.least("l_partkey", "l_suppkey").alias("source_id"),
            F.greatest("l_partkey", "l_suppkey").alias("target_id"),
        )
        .agg(
            F.max("l_tax").alias("tax"),
            F.max("l_discount").alias("discount"),
            F.min("l_linenumber").alias("first"),
            F.min("l_quantity").alias("quantity"),
        )
        .select(
            "source_id",
            "target_id",
            (F.round(F.col("tax") * 100).cast("int") / 10).cast("decimal(4,3)").alias("score"),
            F.lit("trigramme").alias("method"),
            F.when(F.col("first") <= 2, "incertain").alias("verdict"),
            F.lit(None).cast("string").alias("reason"),
            F.when(F.col("discount") >= 0.09, "refusee")
            .when(F.col("discount") >= 0.08, "acceptee")
            .otherwise("proposee")
            .alias("status"),
            "quantity",
        )
    )


def category_proposals(m: Model) -> DataFrame:
    key = F.col("s_suppkey")
    text = key.cast("string")
    code = (
        F.when(F.pmod(key, F.lit(4)) == 0, F.concat(F.lit(" b"), text))
        .when(F.pmod(key, F.lit(4)) == 1, F.concat(F.lit("x."), text))
        .when(F.pmod(key, F.lit(4)) == 2, F.concat(F.lit("bad code "), text))
        .otherwise(F.concat(F.lit("N"), text))
    )
    parent = F.when(F.pmod(F.col("s_nationkey"), F.lit(3)) == 1, "g1").when(
        F.pmod(F.col("s_nationkey"), F.lit(3)) == 2,
        F.concat(F.lit("N"), F.col("s_nationkey").cast("string")),
    )
    return m.table("supplier").select(
        code.alias("code"), F.col("s_name").alias("label"), parent.alias("parent_code"),
        key.alias("ord"),
    )


def category_assignments(m: Model) -> DataFrame:
    return m.table("part").select(
        F.col("p_partkey").alias("item_id"),
        F.concat(F.lit("B"), F.pmod(F.col("p_size"), F.lit(30)).cast("string")).alias("category_code"),
    )


def document_edits(m: Model) -> DataFrame:
    kind = F.col("event_type")
    return m.table("events").select(
        F.col("event_id").alias("document_id"),
        F.col("ts").alias("at"),
        F.when(kind == "error", "rejete").alias("status"),
        F.when(kind == "click", F.pmod("user_id", F.lit(5)).cast("int")).alias("zone_id"),
        F.when(kind == "view", F.col("ts").cast("date")).alias("document_date"),
    )


def payload_segments(m: Model) -> DataFrame:
    """One extraction answer per line: every line is a segment of its order's document."""
    lines = m.lines().join(m.documents(zoned=False), "document_id")
    quantity, price = F.col("quantity").cast("double"), F.col("unit_price").cast("double")
    line = F.struct(
        F.col("ord").alias("ordre"),
        F.lit(1).alias("page"),
        F.concat(F.lit("Article "), F.col("source_item_id").cast("string")).alias("designation"),
        F.col("unit").alias("unite_brute"),
        quantity.alias("quantite"),
        price.alias("pu_ht"),
        F.col("total").cast("double").alias("total_ht"),
        F.col("is_title").alias("est_titre"),
        F.struct(
            F.when(k(3) == 0, F.lit("20/25")).otherwise(F.col("ord").cast("string")).alias("section_mm"),
            (F.col("ord") * 0.5).alias("longueur_m"),
            F.lit("acier").alias("materiau"),
            (k(2) == 0).alias("fourniture_incluse"),
        ).alias("attributs"),
        F.when(k(23) == 2, F.lit(1.5)).otherwise(F.col("confidence")).alias("confiance"),
    )
    kind = F.when(k(23) == 1, "autre").when(k(5) == 0, "indetermine").otherwise(F.col("type"))
    body = F.to_json(
        F.struct(
            kind.alias("type_document"),
            F.col("is_extra").alias("est_ts"),
            F.when(k(4) == 0, F.col("number")).alias("numero_document"),
            F.when(k(6) == 0, F.col("site_title")).alias("chantier_objet"),
            F.col("total").cast("double").alias("total_ht"),
            F.when(k(7) == 0, F.concat(F.lit("ligne "), F.col("ord").cast("string"))).alias("remarques"),
            F.array(line).alias("lignes"),
        )
    )
    payload = (
        F.when(k(23) == 0, F.substring(body, 1, 60))
        .when(k(23) == 3, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .otherwise(body)
    )
    return lines.select(
        F.col("document_id").alias("document_key"),
        F.concat(F.col("ord").cast("string"), F.lit("-"), "line_id").alias("segment"),
        "line_id",
        payload.alias("payload"),
    )


def text_files(m: Model) -> DataFrame:
    ext = _pick(("pdf", "XLSX", "ods", "txt"), F.pmod(F.col("doc_id"), F.lit(4)))
    name = F.concat(F.lit("Pièce n° "), F.col("doc_id").cast("string"), F.lit("."), ext)
    return m.table("documents").select(
        name.alias("file_name"), F.col("text").cast("binary").alias("content"), "lang", "doc_id"
    )


def ledger_events(m: Model) -> DataFrame:
    kind = F.col("event_type")
    state = (
        F.when(kind == "click", "en_attente")
        .when(kind == "view", "extraction")
        .when(kind == "signup", "extrait")
        .when(kind == "purchase", "insere")
        .otherwise("erreur")
    )
    return m.table("events").select(
        F.col("user_id").alias("file"), state.alias("state"), "ts", "event_id"
    )


def batch_answers(m: Model) -> DataFrame:
    kind = F.col("event_type")
    text = F.when(
        kind == "error",
        F.concat(F.lit('{"custom_id":"'), F.col("user_id").cast("string"), F.lit('","response":{"status_code":500}}')),
    ).otherwise(
        F.concat(
            F.lit('{"custom_id":"'), F.col("user_id").cast("string"),
            F.lit('","response":{"status_code":200,"body":{"choices":[{"message":{"content":"e'),
            F.col("event_id").cast("string"), F.lit('"}}]}}}'),
        )
    )
    schema = (
        "custom_id string, error struct<message:string>, response struct<status_code:int,"
        "body:struct<choices:array<struct<message:struct<content:string>>>>>"
    )
    return m.table("events").select("event_id", F.from_json(text, schema).alias("a")).select("event_id", "a.*")


def grouping_answers(m: Model) -> DataFrame:
    """Grouping answers for the unlinked lines of each order: existing, new or unusable items."""
    unlinked = m.lines().join(m.links().select("line_id"), "line_id", "left_anti")
    part = F.col("source_item_id")
    existing = F.when(k(3) == 0, F.concat(F.lit("P-"), (part - 1).cast("string")))
    label = F.when(k(5) != 0, F.concat(F.lit("article "), part.cast("string")))
    return unlinked.select(
        F.col("line_id").alias("group_id"),
        existing.alias("existing_code"),
        F.concat(F.lit("Art. n°"), part.cast("string")).alias("code"),
        label.alias("label_norm"),
        F.initcap(label).alias("label_print"),
        F.concat(F.lit("B"), F.pmod(part, F.lit(30)).cast("string")).alias("category_code"),
        _pick(("m2", "palette", None), k(3)).alias("unit"),
        F.lit(None).cast("boolean").alias("is_lump"),
        F.array("line_id").alias("line_ids"),
    )
