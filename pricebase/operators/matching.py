"""Lines to items: rule matching, alternatives for review, external groupings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricebase.functions.numbers import half_up
from pricebase.functions.skew import running_before
from pricebase.functions.text import LUMP_UNITS, code_slug, search_text
from pricebase.operators.topk_join import topk_join
from pricebase.session import materialized

RULE_THRESHOLD = 0.45
NO_UNIT = "?"
ANY_UNIT = "*"


def lines_to_match(
    lines: DataFrame, links: DataFrame, only_priced: bool = False
) -> DataFrame:
    """Real, in-scope lines without a link."""
    kept = lines.where(~F.col("is_title") & ~F.col("off_scope"))
    if only_priced:
        kept = kept.where(F.col("unit_price") > 0)
    return kept.join(links.select("line_id"), "line_id", "left_anti")


def rule_matching(
    lines: DataFrame, items: DataFrame, threshold: float = RULE_THRESHOLD
) -> DataFrame:
    """Best active item per line with trigram similarity >= threshold.

    Items of a compatible unit come first, then the score, then the smaller id. Identical
    designations are matched once and identical labels once; hot wordings therefore cost one row.
    Only wordings without such an item among the compatible ones go on to the others.
    """
    active = items.where(F.col("active")).select(
        "item_id", "item_unit", search_text(F.col("label_norm")).alias("label")
    )
    # read once: the lines of a catalogue come out of long joins
    lines = materialized(
        lines.select("line_id", "search_text", F.coalesce("unit", F.lit(NO_UNIT)).alias("unit_key"))
    )
    wordings = materialized(lines.select("search_text", "unit_key").distinct())
    units = known_units(wordings)
    compatible = _nearest(wordings, _pool(active, 1, units), 1, threshold).withColumn("ok", F.lit(True))
    rest = wordings.join(compatible, ["search_text", "unit_key"], "left_anti")
    anyone = _nearest(
        materialized(rest.select("search_text", F.lit(ANY_UNIT).alias("unit_key")).distinct()),
        _pool(active, 1),
        1,
        threshold,
    ).drop("unit_key")
    best = compatible.unionByName(
        rest.join(anyone, "search_text").withColumn("ok", F.lit(False))
    )
    return (
        lines.join(best, ["search_text", "unit_key"])
        .select(
            "line_id",
            "item_id",
            half_up(F.col("score"), 3).alias("score"),
            F.lit("regle").alias("method"),
            F.lit(False).alias("validated"),
            F.col("ok").alias("unit_ok"),
        )
    )


def known_units(wordings: DataFrame) -> Column:
    """The units the lines themselves carry, one small array."""
    return wordings.agg(F.collect_set("unit_key")).scalar()


def _pool(active: DataFrame, k: int, units: Column | None = None) -> DataFrame:
    """(label, unit_key, item_id): the first k items of each label among those compatible.

    Copies of a label are interchangeable, so more than k of them are never needed.
    """
    classes = F.array(F.lit(ANY_UNIT)) if units is None else _unit_classes(F.col("item_unit"), units)
    first = Window.partitionBy("label", "unit_key").orderBy("item_id")
    return materialized(
        active.select("item_id", "label", F.explode(classes).alias("unit_key"))
        .withColumn("_n", F.row_number().over(first))
        .where(F.col("_n") <= k)
        .drop("_n")
    )


def _unit_classes(unit: Column, units: Column) -> Column:
    """Line units an item of this unit is compatible with; without unit, all that lines have."""
    lump = F.array(*[F.lit(u) for u in LUMP_UNITS])
    return F.when(unit.isNull(), units).when(unit.isin(*LUMP_UNITS), lump).otherwise(F.array(unit))


def match_alternatives(
    pending: DataFrame,
    items: DataFrame,
    k: int = 3,
) -> DataFrame:
    """The k best other items for every pending line (line_id, item_id, search_text, unit).

    Compatible units come first however low their similarity. What the most similar of them leave
    missing is filled with compatible items of no resemblance, by id, then with the most similar incompatible ones, then with any other
    item by id: whoever has k other items gets k answers.
    """
    active = items.where(F.col("active")).select(
        "item_id", "item_unit", F.col("label_norm").alias("label")
    )
    wordings = materialized(
        pending.select(
            "search_text", F.coalesce("unit", F.lit(NO_UNIT)).alias("unit_key")
        ).distinct()
    )
    units = known_units(wordings)
    per_class = active.select(
        "item_id", F.explode(_unit_classes(F.col("item_unit"), units)).alias("unit_key")
    )
    found = _nearest(wordings, _pool(active, k + 1, units), k + 1)
    counted = found.groupBy("search_text", "unit_key").agg(F.count(F.lit(1)).alias("have"))
    short = wordings.join(counted, ["search_text", "unit_key"], "left").where(
        F.coalesce("have", F.lit(0)) < k + 1
    )
    by_id = Window.partitionBy("unit_key").orderBy("item_id")
    spare = (
        per_class.withColumn("_n", F.row_number().over(by_id))
        .where(F.col("_n") <= 2 * (k + 1))
        .select("unit_key", "item_id")
    )
    fill = (
        short.select("search_text", "unit_key")
        .join(spare, "unit_key")
        .join(found, ["search_text", "unit_key", "item_id"], "left_anti")
        .select("search_text", "unit_key", "item_id", F.lit(0.0).alias("score"))
    )
    ranked = found.withColumn("ok", F.lit(True)).unionByName(fill.withColumn("ok", F.lit(True)))
    # classes with fewer than k+1 items look further: all their items are ranked already
    sizes = per_class.groupBy("unit_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k)
    scarce = materialized(wordings.join(sizes, "unit_key", "left_anti"))
    anyone = _nearest(
        scarce.select("search_text", F.lit(ANY_UNIT).alias("unit_key")).distinct(),
        _pool(active, 3 * (k + 1)),
        3 * (k + 1),
    ).drop("unit_key")
    key = ["search_text", "unit_key", "item_id"]
    others = scarce.join(anyone, "search_text").join(ranked, key, "left_anti").withColumn("ok", F.lit(False))
    ranked = ranked.unionByName(others.select(*ranked.columns))
    first = active.orderBy("item_id").limit(5 * (k + 1)).agg(F.collect_list("item_id")).scalar()
    rest = scarce.withColumn("item_id", F.explode(first)).join(ranked, key, "left_anti")
    rest = rest.select(*key, F.lit(0.0).alias("score"), F.lit(False).alias("ok"))
    ranked = ranked.unionByName(rest.select(*ranked.columns))
    rows = (
        pending.withColumn("unit_key", F.coalesce("unit", F.lit(NO_UNIT)))
        .withColumnRenamed("item_id", "current_item_id")
        .join(ranked, ["search_text", "unit_key"])
        .where(F.col("item_id") != F.col("current_item_id"))
    )
    best = Window.partitionBy("line_id").orderBy(
        F.col("ok").desc(), F.col("score").desc(), F.col("item_id")
    )
    return (
        rows.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("line_id", "rank", "item_id", half_up(F.col("score"), 3).alias("score"), "ok")
    )


def _nearest(wordings: DataFrame, pool: DataFrame, k: int, threshold: float = 0.0) -> DataFrame:
    """Up to k most similar pool items per (wording, class)."""
    found = topk_join(
        wordings.select(F.col("search_text").alias("text"), F.col("unit_key").alias("block")),
        pool.select(F.col("label").alias("text"), F.col("unit_key").alias("block"), "item_id"),
        k,
        threshold,
    )
    return materialized(found.select(F.col("text").alias("search_text"), F.col("block").alias("unit_key"), "item_id", "score"))


def apply_groupings(
    proposals: DataFrame, lines: DataFrame, links: DataFrame, items: DataFrame,
    categories: DataFrame, units: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """External grouping answers -> (new items, links).

    ``proposals``: group_id, existing_code, code, label_norm, label_print, category_code, unit,
    is_lump and line_ids. An existing code wins; otherwise a new item needs both labels, else its
    lines are ignored. Unknown categories and units become NULL. Links never replace existing ones.
    """
    by_code = items.groupBy("code").agg(F.min("item_id").alias("existing_item_id"))
    resolved = proposals.join(
        by_code.withColumnRenamed("code", "existing_code"), "existing_code", "left"
    )
    named = F.col("label_norm").isNotNull() & F.col("label_print").isNotNull()
    fresh = resolved.where(F.col("existing_item_id").isNull() & named)
    slug = code_slug(F.coalesce("code", "label_norm"))
    taken = items.select("code", F.lit(1).alias("taken")).dropDuplicates(["code"])
    based = fresh.withColumn("base_code", slug)
    # the largest number already hung on a code, among stored and new ones
    numbers = (
        items.select("code").unionAll(based.select("base_code"))
        .select(
            F.regexp_extract("code", r"^(.*)-[0-9]{1,9}$", 1).alias("base_code"),
            F.nullif(F.regexp_extract("code", r"-([0-9]{1,9})$", 1), F.lit("")).cast("bigint").alias("number"),
        )
        .where(F.col("number").isNotNull())
        .groupBy("base_code")
        .agg(F.max("number").alias("largest"))
    )
    numbered = running_before(based, "base_code", "group_id", F.lit(1), "_twins")
    coded = (
        numbered.join(taken.withColumnRenamed("code", "base_code"), "base_code", "left")
        .join(numbers, "base_code", "left")
        .withColumn("_n", F.col("_twins") + F.coalesce("taken", F.lit(0)))
        .withColumn(
            "new_code",
            F.when(F.col("_n") == 0, F.col("base_code")).otherwise(
                F.concat_ws("-", "base_code", (F.col("_n") + F.greatest(F.coalesce("largest", F.lit(1)), F.lit(1))).cast("string"))
            ),
        )
    )
    unit_codes = units.select(F.col("code").alias("unit"), F.lit(True).alias("known_unit"))
    known_categories = categories.select("category_code", "category_id")
    new_items = (
        coded.join(unit_codes, "unit", "left")
        .join(known_categories, "category_code", "left")
        .select(
            F.col("group_id"),
            F.col("new_code").alias("code"),
            "label_norm",
            "label_print",
            "category_id",
            F.when(F.col("known_unit"), F.col("unit")).alias("item_unit"),
            F.coalesce("is_lump", F.lit(False)).alias("is_lump"),
        )
    )
    usable = resolved.where(F.col("existing_item_id").isNotNull() | named)
    targets = (
        usable.join(new_items.select("group_id", F.col("code").alias("new_code")), "group_id", "left")
        .select("group_id", "existing_item_id", "new_code", F.explode("line_ids").alias("line_id"))
    )
    per_line = targets.groupBy("line_id").agg(
        F.min(F.struct("group_id", "existing_item_id", "new_code")).alias("t")
    )
    new_links = (
        per_line.join(lines.select("line_id"), "line_id", "left_semi")
        .join(links.select("line_id"), "line_id", "left_anti")
        .select(
            "line_id",
            "t.existing_item_id",
            "t.new_code",
            F.lit("llm").alias("method"),
            F.lit(False).alias("validated"),
        )
    )
    return new_items, new_links
