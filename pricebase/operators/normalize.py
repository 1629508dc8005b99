"""Units, zones, dates and clients of incoming documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricebase.functions.dates import recovered
from pricebase.functions.numbers import half_up
from pricebase.functions.text import search_text, trigrams
from pricebase.operators.topk_join import topk_join
from pricebase.operators.trigram_join import text_side, trigram_join
from pricebase.session import materialized
from pricebase.sources.dims import DEPARTMENT_ZONES

CLIENT_THRESHOLD = 0.55


def normalize_units(lines: DataFrame, aliases: DataFrame) -> DataFrame:
    """unit_raw -> unit, factor and quantity_norm.

    Exact spelling first, then without case. The quantity is converted, the price is not;
    price_unconverted tells where that matters.
    """
    exact = aliases.select(
        F.col("alias").alias("_alias"), F.col("code").alias("_c1"), F.col("factor").alias("_f1")
    )
    folded = (
        aliases.groupBy(F.lower("alias").alias("_folded"))
        .agg(F.min(F.struct("alias", "code", "factor")).alias("_m"))
        .select("_folded", F.col("_m.code").alias("_c2"), F.col("_m.factor").alias("_f2"))
    )
    unit = F.coalesce("_c1", "_c2")
    factor = F.coalesce("_f1", "_f2", F.lit(1).cast("decimal(12,6)"))
    product = F.col("quantity").cast("double") * factor.cast("double")
    return (
        lines.withColumn("_raw", F.trim("unit_raw"))
        .join(exact, F.col("_raw") == F.col("_alias"), "left")
        .join(folded, F.lower("_raw") == F.col("_folded"), "left")
        .withColumn("factor", factor)
        .withColumn("quantity_norm", half_up(product, 3).cast("decimal(14,3)"))
        .withColumn(
            "unit", F.when((unit == "ens") & (F.col("quantity") > 1), F.lit("u")).otherwise(unit)
        )
        .withColumn("price_unconverted", F.col("factor") != 1)
        .drop("_raw", "_alias", "_folded", "_c1", "_c2", "_f1", "_f2")
    )


def _department_zone(postal_code: Column) -> Column:
    zone = F.lit(None).cast("string")
    for department, code in DEPARTMENT_ZONES.items():
        zone = F.when(F.substring(postal_code, 1, 2) == department, code).otherwise(zone)
    return zone


def resolve_zones(documents: DataFrame, zone_towns: DataFrame) -> DataFrame:
    """Zone from the site's postal code (reliable), else from the client's (deduced).

    A postal code shared by towns of several zones takes the smallest zone code.
    """
    per_code = zone_towns.groupBy("postal_code").agg(F.min("zone_code").alias("zone"))

    def named(prefix: str) -> DataFrame:
        return per_code.select(
            F.col("postal_code").alias(f"_{prefix}_pc"), F.col("zone").alias(f"_{prefix}_zone")
        )

    site, client = F.trim("site_postal_code"), F.trim("client_postal_code")
    joined = documents.join(named("site"), site == F.col("_site_pc"), "left").join(
        named("client"), client == F.col("_client_pc"), "left"
    )
    from_site = F.coalesce("_site_zone", _department_zone(site))
    from_client = F.coalesce("_client_zone", _department_zone(client))
    return (
        joined.withColumn("zone_code", F.coalesce(from_site, from_client))
        .withColumn("zone_reliable", from_site.isNotNull())
        .drop("_site_pc", "_site_zone", "_client_pc", "_client_zone")
    )


def recover_dates(documents: DataFrame, last_year: Column | None = None) -> DataFrame:
    """date_text and file_name -> document_date and date_source."""
    # unfolded from a one-element array: the planner cannot repeat the readings per column
    found = recovered(F.col("date_text"), F.col("file_name"), last_year)
    kept = [c for c in documents.columns if c not in ("document_date", "date_source")]
    return documents.select(*kept, F.explode(F.array(found)).alias("_found")).select(
        *kept, "_found.document_date", "_found.date_source"
    )


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) with component = smallest node name reachable.

    Alternates hooking to the smallest neighbour with pointer jumping, so the number of rounds
    grows with the logarithm of the longest chain. Each round is checkpointed to shared storage.
    """
    both = edges.select("a", "b").unionByName(
        edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    )
    both = materialized(both.where(F.col("a") != F.col("b")).distinct())
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(max_rounds):
        neighbour = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        hooked = labels.join(neighbour, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        parents = hooked.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = hooked.join(parents, "label", "left").select(
            "node", "old", F.coalesce(F.least("up", "label"), "label").alias("label")
        )
        jumped = materialized(jumped)
        labels = jumped.select("node", "label")
        if jumped.where(F.col("label") != F.col("old")).isEmpty():
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError("connected components did not settle")


def match_clients(
    names: DataFrame, clients: DataFrame, aliases: DataFrame, threshold: float = CLIENT_THRESHOLD
) -> DataFrame:
    """Distinct raw names -> client by exact alias, else by the most similar client name.

    ``names`` has one column raw_name. Unmatched names come back with a NULL client.
    """
    distinct = names.select(F.trim("raw_name").alias("raw_name")).where(
        F.col("raw_name") != ""
    ).distinct()
    known = aliases.groupBy(F.col("alias").alias("raw_name")).agg(
        F.min("client_id").alias("alias_client")
    )
    # read once: the names come out of all documents
    with_alias = materialized(distinct.join(known, "raw_name", "left"))
    open_names = (
        with_alias.where(F.col("alias_client").isNull())
        .select("raw_name", search_text(F.col("raw_name")).alias("text"))
    )
    texts = clients.groupBy(search_text(F.col("name")).alias("text")).agg(
        F.min("client_id").alias("client_id")
    )
    best = _most_similar(open_names.select("text").distinct(), texts, threshold)
    return (
        with_alias.withColumn("text", search_text(F.col("raw_name")))
        .join(best, "text", "left")
        .select(
            "raw_name",
            F.coalesce("alias_client", "similar_client").alias("client_id"),
            F.when(F.col("alias_client").isNotNull(), "alias")
            .when(F.col("similar_client").isNotNull(), "trigramme")
            .otherwise("nouveau")
            .alias("method"),
            F.when(F.col("alias_client").isNull(), F.col("score")).alias("score"),
        )
    )


def _most_similar(names: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(text, score, similar_client) of the names that a client is similar to, the smallest of equals.

    Names with the very trigrams of a client have found it; only the others look for the best of all.
    """
    asked = materialized(_with_grams(names))
    same_grams = _with_grams(texts).groupBy("grams").agg(F.min("client_id").alias("similar_client"))
    same = materialized(asked.join(same_grams, "grams").select("text", F.lit(1.0).alias("score"), "similar_client"))
    # a client without id comes after the others of its similarity
    block, nobody = F.lit("").alias("block"), F.lit((1 << 63) - 1)
    found = topk_join(
        asked.join(same, "text", "left_anti").select("text", block),
        texts.select("text", block, F.coalesce(F.col("client_id").cast("bigint"), nobody).alias("item_id")),
        1,
        threshold,
    )
    client = F.nullif(F.col("item_id"), nobody).cast(texts.schema["client_id"].dataType)
    return same.unionByName(found.select("text", "score", client.alias("similar_client")))


def _with_grams(texts: DataFrame) -> DataFrame:
    """Texts that have trigrams, with their set in one order."""
    return texts.withColumn("grams", F.array_sort(trigrams(F.col("text")))).where(F.size("grams") > 0)


def new_aliases(matches: DataFrame) -> DataFrame:
    """Spellings to remember for the next imports."""
    return matches.where(F.col("method") == "trigramme").select(
        F.col("raw_name").alias("alias"), "client_id"
    )


def new_clients(matches: DataFrame, threshold: float = CLIENT_THRESHOLD) -> DataFrame:
    """Unmatched names grouped into new clients named after their smallest spelling.

    One document after the other, a later spelling would join the client an earlier one created;
    in a batch, spellings linked by similarity form one client.
    """
    fresh = materialized(
        matches.where(F.col("method") == "nouveau").select(
            "raw_name", search_text(F.col("raw_name")).alias("text")
        )
    )
    pairs = trigram_join(text_side(fresh, "text"), None, threshold)
    components = connected_components(
        pairs.select(F.col("left_id").alias("a"), F.col("right_id").alias("b"))
    )
    return fresh.join(components, fresh.text == components.node, "left").select(
        "raw_name", F.coalesce("component", "text").alias("client_key")
    )
