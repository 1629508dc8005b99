"""Bulk state changes of the link table, with their journal and its undo.

Nothing is updated in place: each gesture takes the current tables and a command table and returns
the next tables plus the journal rows (before-images) that make it reversible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricebase.functions.skew import count_per_key
from pricebase.functions.skew import running_before
from pricebase.functions.text import is_category_code, unit_compatible
from pricebase.session import materialized

STATE = ("item_id", "score", "method", "validated", "validated_by", "validated_on")
AUTO = ("auto", "auto-llm")
AUTO_THRESHOLD = 0.8
LINES_SHOWN = 60


def snapshot() -> Column:
    return F.struct(*STATE)


def _journal(rows: DataFrame, action: str) -> DataFrame:
    """The one shape of all journals: their union is what ``undo_last`` reads.

    ``seq`` is the time of the gesture in microseconds; a gesture touches a link at most once.
    """

    def named(column: str) -> Column:
        known = F.col(column) if column in rows.columns else F.lit(None)
        return known.cast("bigint").alias(column)

    return rows.select(
        F.unix_micros(F.col("at").cast("timestamp")).alias("seq"), "batch_id", F.lit(action).alias("action"), "link_id", "before",
        named("created_item_id"), named("merged_item_id"), "actor", "at",
        F.lit(None).cast("timestamp").alias("undone_at"),
    )


# ---- C1-C3: validate, validate per item, un-validate ----------------------


def bulk_validate(links: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Validates links (link_id, batch_id, new_item_id, actor, at); a new item repoints first.

    Only links not yet validated, or validated on another item, change. Of several commands for a
    link the latest counts.
    """
    latest = (
        commands.groupBy("link_id")
        .agg(F.max(F.struct("at", "batch_id", "actor", "new_item_id")).alias("_c"))
        .select("link_id", "_c.*")
    )
    joined = links.join(latest, "link_id", "left")
    repoints = F.col("new_item_id").isNotNull()
    hit = F.col("at").isNotNull() & (
        ~F.col("validated") | (repoints & (F.col("new_item_id") != F.col("item_id")))
    )
    marked = joined.withColumn("_hit", hit).withColumn("before", snapshot())
    changed = F.col("_hit")
    moved = changed & repoints
    after = marked.withColumns(
        {
            "item_id": F.when(moved, F.col("new_item_id")).otherwise(F.col("item_id")),
            "method": F.when(moved, "manuel").otherwise(F.col("method")),
            "score": F.when(moved, F.lit(1).cast("decimal(4,3)")).otherwise(F.col("score")),
            "validated": changed | F.col("validated"),
            "validated_by": F.when(changed, F.col("actor")).otherwise(F.col("validated_by")),
            "validated_on": F.when(changed, F.to_date("at")).otherwise(F.col("validated_on")),
        }
    ).select(*links.columns)
    action = F.when(repoints, "modifier").otherwise("valider")
    return after, _journal(marked.where(changed), action)


def validation_per_item(
    linked: DataFrame,
    documents: DataFrame,
    items: DataFrame,
    targets: DataFrame,
    excluded: DataFrame | None = None,
    strict: bool = True,
) -> DataFrame:
    """Pending links of the target items: link_id, item_id, taken (unit-compatible or not strict)."""
    pending = (
        linked.where(~F.col("validated"))
        .join(targets.select("item_id").distinct(), "item_id", "left_semi")
        .join(documents.where(F.col("status") != "rejete").select("document_id"), "document_id",
              "left_semi")
        .join(items.select("item_id", "item_unit"), "item_id")
    )
    if excluded is not None:
        pending = pending.join(excluded.select("link_id"), "link_id", "left_anti")
    taken = unit_compatible(F.col("unit"), F.col("item_unit")) if strict else F.lit(True)
    return pending.select("link_id", "item_id", taken.alias("taken"))


def validation_report(selection: DataFrame) -> DataFrame:
    """Per item: links validated and links left out for their unit."""
    return selection.groupBy("item_id").agg(
        F.count_if("taken").alias("n_validated"),
        F.count_if(~F.col("taken")).alias("n_unit_ignored"),
    )


def unvalidate(links: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Takes the validation back (link_id, batch_id, actor, at)."""
    latest = (
        commands.groupBy("link_id")
        .agg(F.max(F.struct("at", "batch_id", "actor")).alias("_c"))
        .select("link_id", "_c.*")
    )
    marked = (
        links.join(latest, "link_id", "left")
        .withColumn("_hit", F.col("at").isNotNull() & F.col("validated"))
        .withColumn("before", snapshot())
    )
    changed = F.col("_hit")
    after = marked.withColumns(
        {
            "validated": F.col("validated") & ~changed,
            "validated_by": F.when(~changed, F.col("validated_by")),
            "validated_on": F.when(~changed, F.col("validated_on")),
        }
    ).select(*links.columns)
    return after, _journal(marked.where(changed), "devalider")


def automatic_validations(links: DataFrame) -> DataFrame:
    """Links a mass undo of the automatic validations takes back."""
    return links.where(F.col("validated") & F.col("validated_by").isin(*AUTO))


# ---- C4: automatic validation ---------------------------------------------


def auto_validation_candidates(
    linked: DataFrame, documents: DataFrame, items: DataFrame, threshold: float = AUTO_THRESHOLD
) -> DataFrame:
    """Pending rule matches of high score, known and compatible unit, active item."""
    return (
        linked.where(
            ~F.col("validated")
            & (F.col("method") == "regle")
            & (F.col("score") >= threshold)
            & F.col("unit").isNotNull()
        )
        .join(documents.where(F.col("status") != "rejete").select("document_id"), "document_id",
              "left_semi")
        .join(
            items.where(F.col("active")).select("item_id", "item_unit", "label_print"), "item_id"
        )
        .where(unit_compatible(F.col("unit"), F.col("item_unit")))
        .select("link_id", "item_id", "label_print", "score")
    )


def auto_validation_report(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("item_id", "label_print").agg(
        F.count(F.lit(1)).alias("n_candidates")
    )


# ---- C5: attach lines ------------------------------------------------------


def _orphans(lines: DataFrame, links: DataFrame) -> DataFrame:
    """Unlinked priced lines: line_id, search_text."""
    priced = lines.where(~F.col("is_title") & (F.col("unit_price") > 0)).select("line_id", "search_text")
    return priced.join(links.select("line_id"), "line_id", "left_anti")


def identical_orphans(lines: DataFrame, links: DataFrame, chosen: DataFrame) -> DataFrame:
    """Chosen lines with how many unlinked priced lines are worded exactly like them.

    One row per chosen line (chosen_id, search_text, n_identical): orphans are counted per wording
    before they meet the chosen lines, so no wording unfolds into chosen lines x orphans.
    """
    wanted = lines.join(chosen.select("line_id").distinct(), "line_id", "left_semi").select(
        F.col("line_id").alias("chosen_id"), "search_text"
    )
    counts = _orphans(lines, links).groupBy("search_text").agg(F.count(F.lit(1)).alias("n_identical"))
    return wanted.join(counts, "search_text").select("chosen_id", "search_text", "n_identical")


def identical_commands(lines: DataFrame, links: DataFrame, commands: DataFrame) -> DataFrame:
    """Attach commands for the unlinked priced lines worded like a line of the given commands.

    Each wording has one answer, that of its latest command; lines with a command of their own keep
    it. One row per attached line, in the shape ``attach_lines`` takes.
    """
    fields = ["target_item_id", "batch_id", "actor", "at"]
    worded = commands.select("line_id", *fields).join(lines.select("line_id", "search_text"), "line_id")
    latest = worded.groupBy("search_text").agg(
        F.max(F.struct("at", "batch_id", "actor", "target_item_id")).alias("_c")
    )
    return (
        _orphans(lines, links)
        .join(commands.select("line_id").distinct(), "line_id", "left_anti")
        .join(latest, "search_text")
        .select("line_id", *[F.col(f"_c.{f}").alias(f) for f in fields])
    )


def attach_lines(links: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Upsert: lines (line_id, target_item_id, batch_id, actor, at) get a validated manual link.

    A line without link gets one whose id is the line's; its before-image is NULL. Commands may
    name the item they created (``created_item_id``), which an undo switches off again.
    """
    created = [c for c in ("created_item_id",) if c in commands.columns]
    latest = (
        commands.groupBy("line_id")
        .agg(F.max(F.struct("at", "batch_id", "actor", "target_item_id", *created)).alias("_c"))
        .select("line_id", "_c.*")
    )
    marked = (
        links.join(latest, "line_id", "full")
        .withColumn("_new", F.col("link_id").isNull())
        .withColumn("before", F.when(F.col("link_id").isNotNull(), snapshot()))
        .withColumn("link_id", F.coalesce("link_id", "line_id"))
        .withColumn("_hit", F.col("at").isNotNull())
    )
    hit = F.col("_hit")
    values = {
        "item_id": F.when(hit, F.col("target_item_id")).otherwise(F.col("item_id")),
        "score": F.when(hit, F.lit(1).cast("decimal(4,3)")).otherwise(F.col("score")),
        "method": F.when(hit, "manuel").otherwise(F.col("method")),
        "validated": hit | F.coalesce("validated", F.lit(False)),
        "validated_by": F.when(hit, F.col("actor")).otherwise(F.col("validated_by")),
        "validated_on": F.when(hit, F.to_date("at")).otherwise(F.col("validated_on")),
        "excluded": F.coalesce("excluded", F.lit(False)),
    }
    after = marked.withColumns(values).select(*links.columns)
    return after, _journal(marked.where(hit), "rattacher")


# ---- C6-C7: merges and proposals -------------------------------------------


def resolve_chains(merges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(source_id, target_id) with every target final, by pointer doubling."""
    current = merges.groupBy("source_id").agg(F.min("target_id").alias("target_id"))
    current = current.where(F.col("source_id") != F.col("target_id"))
    current = materialized(current)
    for _ in range(max_rounds):
        further = current.select(
            F.col("source_id").alias("target_id"), F.col("target_id").alias("next_id")
        )
        stepped = materialized(current.join(further, "target_id", "left"))
        if stepped.where(F.col("next_id").isNotNull()).isEmpty():
            return current
        current = stepped.select("source_id", F.coalesce("next_id", "target_id").alias("target_id"))
    raise ValueError("the merges form a cycle")


def _latest_merges(merges: DataFrame) -> DataFrame:
    """source_id, target_id, batch_id, actor, at: the one command per source that counts."""
    given = merges
    for column, default in (
        ("batch_id", F.lit("fusion")), ("actor", F.lit(None).cast("string")), ("at", F.current_timestamp()),
    ):
        if column not in given.columns:
            given = given.withColumn(column, default)
    given = given.where(F.col("source_id") != F.col("target_id"))
    latest = F.max(F.struct("at", (-F.col("target_id")).alias("_smaller"), "target_id", "batch_id", "actor"))
    return given.groupBy("source_id").agg(latest.alias("_c")).select(
        "source_id", "_c.target_id", "_c.batch_id", "_c.actor", "_c.at"
    )


def conflicting_merges(merges: DataFrame) -> DataFrame:
    """Commands that do not count because another one for the same source does: source_id, target_id, kept_target_id."""
    kept = _latest_merges(merges).select("source_id", F.col("target_id").alias("kept_target_id"))
    pairs = merges.select("source_id", "target_id").where(F.col("source_id") != F.col("target_id")).distinct()
    return pairs.join(kept, "source_id").where(F.col("target_id") != F.col("kept_target_id"))


def merge_items(
    links: DataFrame, items: DataFrame, proposals: DataFrame, merges: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Repoints the links of merged items; returns (links, items, proposals, journal).

    ``merges``: source_id, target_id and, if known, batch_id, actor and at; of several targets of a
    source the latest command counts (without times the smallest target), and
    ``conflicting_merges`` reports the others. Merged items become inactive, and other open
    proposals that touch them obsolete. A merge without links is still journalled, with a NULL link.
    """
    # the search for proposals behind the commands runs once, not once per use of them
    chosen = materialized(_latest_merges(merges))
    final = materialized(resolve_chains(chosen).join(chosen.drop("target_id"), "source_id"))
    target = final.select(F.col("source_id").alias("item_id"), F.col("target_id").alias("_to"))
    marked = links.join(target, "item_id", "left").withColumn("before", snapshot())
    after = marked.withColumn("item_id", F.coalesce("_to", "item_id")).select(*links.columns)
    entries = marked.where(F.col("_to").isNotNull()).select(
        F.col("item_id").alias("merged_item_id"), "link_id", "before"
    )
    by_source = final.select(F.col("source_id").alias("merged_item_id"), "batch_id", "actor", "at")
    journal = _journal(by_source.join(entries, "merged_item_id", "left"), "fusion")
    gone = final.select(F.col("source_id").alias("item_id"), F.lit(True).alias("_gone"))
    items_after = (
        items.join(gone, "item_id", "left")
        .withColumn("active", F.col("active") & F.col("_gone").isNull())
        .select(*items.columns)
    )
    merged = final.select(F.col("source_id").alias("_merged"))
    touched = (
        proposals.withColumn("_merged", F.explode(F.array("source_id", "target_id")))
        .join(merged, "_merged", "left_semi")
        .select("source_id", "target_id")
        .distinct()
        .withColumn("_touched", F.lit(True))
    )
    proposals_after = (
        proposals.join(touched, ["source_id", "target_id"], "left")
        .withColumn(
            "status",
            F.when((F.col("status") == "proposee") & F.col("_touched"), "obsolete").otherwise(
                F.col("status")
            ),
        )
        .select(*proposals.columns)
    )
    return after, items_after, proposals_after, journal


def apply_verdicts(proposals: DataFrame, verdicts: DataFrame) -> DataFrame:
    """External verdicts (source_id, target_id, verdict, reason): 'distinct' refuses."""
    given = verdicts.select(
        "source_id", "target_id", F.col("verdict").alias("_v"), F.col("reason").alias("_r")
    )
    open_one = (F.col("status") == "proposee") & F.col("_v").isNotNull()
    return (
        proposals.join(given, ["source_id", "target_id"], "left")
        .withColumns(
            {
                "verdict": F.when(open_one, F.col("_v")).otherwise(F.col("verdict")),
                "reason": F.when(open_one, F.coalesce("_r", "reason")).otherwise(F.col("reason")),
                "status": F.when(open_one & (F.col("_v") == "distinct"), "refusee").otherwise(
                    F.col("status")
                ),
            }
        )
        .select(*proposals.columns)
    )


def decide_proposals(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """Human decisions (source_id, target_id, accept, invert) on open proposals."""
    given = decisions.select("source_id", "target_id", "accept", "invert")
    joined = proposals.join(given, ["source_id", "target_id"], "left")
    open_one = (F.col("status") == "proposee") & F.col("accept").isNotNull()
    flip = open_one & F.col("accept") & F.col("invert")
    status = (
        F.when(open_one & F.col("accept"), "acceptee")
        .when(open_one, "refusee")
        .otherwise(F.col("status"))
    )
    return (
        joined.withColumn("_flip", F.coalesce(flip, F.lit(False)))
        .withColumns(
            {
                "source_id": F.when(F.col("_flip"), F.col("target_id")).otherwise(F.col("source_id")),
                "target_id": F.when(F.col("_flip"), F.col("source_id")).otherwise(F.col("target_id")),
                "status": status,
            }
        )
        .select(*proposals.columns)
    )


def proposal_status_report(proposals: DataFrame) -> DataFrame:
    return proposals.agg(
        F.count_if(F.col("status") == "proposee").alias("n_open"),
        F.count_if(F.col("status") == "refusee").alias("n_refused"),
        F.count_if(F.col("status") == "acceptee").alias("n_accepted"),
    )


def validation_status_report(links: DataFrame, base: DataFrame) -> DataFrame:
    priced = base.agg(F.count_distinct("item_id").alias("n"))
    return links.agg(
        F.count_if("validated").alias("n_validated"),
        F.count_if(~F.col("validated")).alias("n_pending"),
    ).withColumn("n_priced_items", priced.scalar())


# ---- C8: undo ----------------------------------------------------------------


def last_gestures(journal: DataFrame, k: int = 1) -> DataFrame:
    """The k latest gestures not undone yet: batch_id, action, entries with a link, when."""
    return (
        journal.where(F.col("undone_at").isNull())
        .groupBy("batch_id")
        .agg(
            F.max_by("action", "seq").alias("action"),
            F.count("link_id").alias("n"),
            F.max("at").alias("last_at"),
            F.max("seq").alias("last_seq"),
        )
        .orderBy(F.col("last_at").desc(), F.col("last_seq").desc())
        .limit(k)
    )


def undo_last(
    links: DataFrame, items: DataFrame, proposals: DataFrame, journal: DataFrame, k: int = 1
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Undoes the k latest gestures; returns (links, items, proposals, journal).

    Each link goes back to its oldest before-image among them; a link that did not exist then
    disappears. A created item without any link left is switched off; a merged item and its
    accepted proposals come back.
    """
    batches = last_gestures(journal, k).select("batch_id")
    entries = journal.where(F.col("undone_at").isNull()).join(batches, "batch_id", "left_semi")
    images = (
        entries.where(F.col("link_id").isNotNull())
        .groupBy("link_id")
        .agg(F.min_by(F.struct("before"), "seq").alias("_image"))
        .select("link_id", F.lit(True).alias("_undone"), F.col("_image.before").alias("_b"))
    )
    restored = links.join(images, "link_id", "left").where(
        F.col("_undone").isNull() | F.col("_b").isNotNull()
    )
    after = restored.withColumns(
        {c: F.when(F.col("_undone"), F.col(f"_b.{c}")).otherwise(F.col(c)) for c in STATE}
    ).select(*links.columns)

    def named(column: str, flag: str) -> DataFrame:
        return (
            entries.where(F.col(column).isNotNull())
            .select(F.col(column).alias("item_id"))
            .distinct()
            .withColumn(flag, F.lit(True))
        )

    used = after.select("item_id").distinct().withColumn("_used", F.lit(True))
    items_after = (
        items.join(named("created_item_id", "_created"), "item_id", "left")
        .join(named("merged_item_id", "_merged"), "item_id", "left")
        .join(used, "item_id", "left")
        .withColumn(
            "active",
            F.when(F.col("_merged"), True)
            .when(F.col("_created") & F.col("_used").isNull(), False)
            .otherwise(F.col("active")),
        )
        .select(*items.columns)
    )
    back = named("merged_item_id", "_merged").withColumnRenamed("item_id", "source_id")
    proposals_after = (
        proposals.join(back, "source_id", "left")
        .withColumn(
            "status",
            F.when((F.col("status") == "acceptee") & F.col("_merged"), "proposee").otherwise(
                F.col("status")
            ),
        )
        .select(*proposals.columns)
    )
    journal_after = (
        journal.join(batches.withColumn("_now", F.current_timestamp()), "batch_id", "left")
        .withColumn("undone_at", F.coalesce("undone_at", "_now"))
        .select(*journal.columns)
    )
    return after, items_after, proposals_after, journal_after


# ---- C9-C11: overlays --------------------------------------------------------


def apply_exclusions(links: DataFrame, changes: DataFrame) -> DataFrame:
    """Latest change per line (line_id, exclude, reason, at) decides whether it counts."""
    latest = changes.groupBy("line_id").agg(
        F.max(F.struct("at", "exclude", "reason")).alias("_x")
    )
    hit = F.col("_x").isNotNull()
    return (
        links.join(latest, "line_id", "left")
        .withColumns(
            {
                "excluded": F.when(hit, F.col("_x.exclude")).otherwise(F.col("excluded")),
                "exclusion_reason": F.when(hit & F.col("_x.exclude"), F.col("_x.reason")).when(
                    ~hit, F.col("exclusion_reason")
                ),
            }
        )
        .select(*links.columns)
    )


def apply_document_edits(documents: DataFrame, edits: DataFrame) -> DataFrame:
    """Edited fields win over the source; a NULL edit keeps it.

    ``edits``: document_id, at and any of status, document_date, type, is_extra, number,
    site_title, client_id, zone_id. A date typed by hand has the provenance 'humain', a zone set by
    hand is reliable.
    """
    fields = [c for c in edits.columns if c not in ("document_id", "at")]
    latest = edits.groupBy("document_id").agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("at"))).alias(f"_e_{f}") for f in fields]
    )
    joined = documents.join(latest, "document_id", "left")
    values = {f: F.coalesce(f"_e_{f}", f) for f in fields}
    if "document_date" in fields and "date_source" in documents.columns:
        values["date_source"] = F.when(F.col("_e_document_date").isNotNull(), "humain").otherwise(
            F.col("date_source")
        )
    if "zone_id" in fields and "zone_reliable" in documents.columns:
        values["zone_reliable"] = F.when(F.col("_e_zone_id").isNotNull(), True).otherwise(
            F.col("zone_reliable")
        )
    return joined.withColumns(values).select(*documents.columns)


def apply_scope_reviews(lines: DataFrame, reviews: DataFrame) -> DataFrame:
    """Off-scope lines confirmed or reinstated (line_id, confirm, actor, at)."""
    latest = reviews.groupBy("line_id").agg(
        F.max(F.struct("at", "confirm", "actor")).alias("_r")
    )
    hit = F.col("off_scope") & F.col("_r").isNotNull()
    tag = F.when(F.col("_r.confirm"), F.concat(F.lit("humain:"), F.col("_r.actor"))).otherwise(
        F.concat(F.lit("reintegre:"), F.col("_r.actor"))
    )
    return (
        lines.join(latest, "line_id", "left")
        .withColumns(
            {
                "off_scope_reason": F.when(hit, tag).otherwise(F.col("off_scope_reason")),
                "off_scope": F.col("off_scope") & ~(hit & ~F.col("_r.confirm")),
            }
        )
        .select(*lines.columns)
    )


# ---- C12-C13: categories -----------------------------------------------------


def valid_category_proposals(proposed: DataFrame, categories: DataFrame) -> DataFrame:
    """Well-formed new codes whose parent exists or is itself proposed."""
    clean = proposed.select(
        F.upper(F.trim("code")).alias("code"),
        F.trim("label").alias("label"),
        F.nullif(F.upper(F.trim("parent_code")), F.lit("")).alias("parent_code"),
        "ord",
    )
    existing = categories.select(F.col("category_code").alias("code"))
    parents = (
        existing.select(F.col("code").alias("parent_code"))
        .unionByName(proposed.select(F.upper("code").alias("parent_code")))
        .distinct()
        .withColumn("_parent", F.lit(True))
    )
    return (
        clean.where(is_category_code(F.col("code")))
        .join(existing, "code", "left_anti")
        .join(parents, "parent_code", "left")
        .where(F.col("parent_code").isNull() | F.col("_parent"))
        .groupBy("code")
        .agg(F.min(F.struct("label", "parent_code", "ord")).alias("_p"))
        .select("code", "_p.*")
    )


def category_proposal_listing(proposals: DataFrame, assignments: DataFrame) -> DataFrame:
    """Proposals not refused, with the items proposed for them."""
    counts = (
        assignments.where(F.col("status") == "propose")
        .groupBy(F.col("category_code").alias("code"))
        .agg(F.count(F.lit(1)).alias("n_items"))
    )
    return (
        proposals.where(F.col("status") != "refuse")
        .join(counts, "code", "left")
        .fillna(0, ["n_items"])
    )


def acceptable_categories(proposals: DataFrame, categories: DataFrame) -> DataFrame:
    """Open proposals whose parent already exists (or that are roots): acceptable now."""
    known = categories.select(
        F.col("category_code").alias("parent_code"), F.col("category_id").alias("parent_id")
    )
    return (
        proposals.where(F.col("status") == "propose")
        .join(known, "parent_code", "left")
        .where(F.col("parent_code").isNull() | F.col("parent_id").isNotNull())
    )


def replaced_proposals(stored: DataFrame, proposed: DataFrame, key: str) -> DataFrame:
    """A new answer replaces the open proposals; decided ones stay unless it names them again.

    Serves categories (``key`` = code) and assignments (``key`` = item_id); both have a status.
    """
    fresh = proposed.withColumn("status", F.lit("propose"))
    decided = stored.where(F.col("status") != "propose").join(fresh.select(key), key, "left_anti")
    return decided.unionByName(fresh, allowMissingColumns=True)


def accept_categories(
    proposals: DataFrame, categories: DataFrame, accepted: DataFrame, max_rounds: int = 60
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Creates the accepted proposals (``accepted``: code), parents first.

    Level by level, a proposal is created once its parent exists, was accepted before, or was created
    by a level above; a whole chain can be accepted in one call. Returns the proposals with status
    and category_id, the categories, and the blocked ones, whose parent is still to be accepted.
    New numbers follow the largest one in the order of the codes; a code that exists is taken over.
    """
    existing = categories.groupBy(F.col("category_code").alias("code")).agg(F.min("category_id").alias("known_id"))
    open_ = materialized(
        proposals.join(accepted.select("code").distinct(), "code", "left_semi")
        .where(F.col("status") != "accepte")
        .join(existing, "code", "left")
    )
    reached = existing.select("code").union(proposals.where("status = 'accepte'").select("code")).distinct()
    left, done = open_, None
    for _ in range(max_rounds):
        above = reached.select(F.col("code").alias("parent_code"), F.lit(True).alias("_ready"))
        ready = left.join(above, "parent_code", "left").where(
            F.col("parent_code").isNull() | F.col("_ready") | F.col("known_id").isNotNull()
        )
        ready = materialized(ready.select(*open_.columns))
        if ready.isEmpty():
            break
        done = ready if done is None else done.unionByName(ready)
        left = materialized(left.join(ready.select("code"), "code", "left_anti"))
        reached = ready.select("code")
    if done is None:
        done = open_.limit(0)
    largest = categories.agg(F.coalesce(F.max("category_id"), F.lit(0))).scalar()
    new = running_before(done.where("known_id is null").withColumn("_all", F.lit(0)), "_all", "code", F.lit(1), "_before")
    new = materialized(new.select("code", "label", "parent_code", "ord", (largest + F.col("_before") + 1).cast("int").alias("known_id")))
    numbers = done.where("known_id is not null").select("code", F.col("known_id").cast("int").alias("category_id")).union(
        new.select("code", "known_id")
    )
    if "category_id" not in proposals.columns:
        proposals = proposals.withColumn("category_id", F.lit(None).cast("int"))
    after = (
        proposals.withColumnRenamed("category_id", "_old")
        .join(numbers, "code", "left")
        .withColumn("status", F.when(F.col("category_id").isNotNull(), "accepte").otherwise(F.col("status")))
        .withColumn("category_id", F.coalesce("category_id", "_old"))
        .select(*proposals.columns)
    )
    earlier = after.where("status = 'accepte'").select(F.col("code").alias("parent_code"), F.col("category_id").alias("_proposed"))
    parents = existing.select(F.col("code").alias("parent_code"), F.col("known_id").alias("_existing"))
    created = new.join(parents, "parent_code", "left").join(earlier, "parent_code", "left").select(
        F.col("known_id").alias("category_id"), F.col("code").alias("category_code"), F.col("label").alias("category_label"),
        F.coalesce("_existing", "_proposed").cast("int").alias("parent_id"), F.col("ord").cast("int").alias("category_ord"),
    )
    return after, categories.unionByName(created), left.select("code", "parent_code")


def refuse_categories(
    proposals: DataFrame, assignments: DataFrame, refused: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Refused proposals (``refused``: code), and the open assignments to them refused too."""
    marked = refused.select("code", F.lit(True).alias("_no")).distinct()
    status = F.when(F.col("_no"), "refuse").otherwise(F.col("status"))
    proposals_after = proposals.join(marked, "code", "left").withColumn("status", status).select(*proposals.columns)
    by_code = marked.withColumnRenamed("code", "category_code")
    still = F.when(F.col("_no") & (F.col("status") == "propose"), "refuse").otherwise(F.col("status"))
    after = assignments.join(by_code, "category_code", "left").withColumn("status", still).select(*assignments.columns)
    return proposals_after, after


def apply_assignments(
    items: DataFrame, assignments: DataFrame, categories: DataFrame, codes: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Open assignments to the named categories (``codes``: code) carried out, where these exist."""
    known = categories.select("category_code").join(
        codes.select(F.col("code").alias("category_code")), "category_code", "left_semi"
    ).distinct()
    due = assignments.where("status = 'propose'").join(known, "category_code", "left_semi")
    marked = known.withColumn("_due", F.lit(True))
    status = F.when(F.col("_due") & (F.col("status") == "propose"), "accepte").otherwise(F.col("status"))
    after = assignments.join(marked, "category_code", "left").withColumn("status", status).select(*assignments.columns)
    return assign_items(items, due, categories), after


def assign_items(items: DataFrame, assignments: DataFrame, categories: DataFrame) -> DataFrame:
    """Applies item -> category assignments (item_id, category_code) that name a known category."""
    known = categories.select("category_code", F.col("category_id").alias("_to"))
    moves = (
        assignments.join(known, "category_code")
        .groupBy("item_id")
        .agg(F.min("_to").alias("_to"))
    )
    return (
        items.join(moves, "item_id", "left")
        .withColumn("category_id", F.coalesce("_to", "category_id"))
        .select(*items.columns)
    )


def items_of_categories(items: DataFrame, links: DataFrame) -> DataFrame:
    """Active items with their category (possibly none) and number of links."""
    counts = links.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_links"))
    return (
        items.where(F.col("active"))
        .join(counts, "item_id", "left")
        .fillna(0, ["n_links"])
        .select("category_id", "item_id", "label_print", "n_links")
    )


# ---- A16, C15-C17: queues ------------------------------------------------------


def pending_lines(linked: DataFrame, documents: DataFrame, items: DataFrame) -> DataFrame:
    """Links awaiting validation in documents that are not rejected."""
    return (
        linked.where(~F.col("validated"))
        .join(
            documents.where(F.col("status") != "rejete").select(
                "document_id", "document_date", "status"
            ),
            "document_id",
        )
        .join(
            items.select("item_id", "item_unit", "label_print", "label_norm", "active",
                         "category_id"),
            "item_id",
        )
        .withColumn("unit_ok", unit_compatible(F.col("unit"), F.col("item_unit")))
    )


def item_queue(pending: DataFrame, links: DataFrame) -> DataFrame:
    """Per active item: pending links, those that would enter the prices, validated ones, three
    sample wordings. The wordings are cut to three per item before they are gathered."""
    rows = pending.where(F.col("active"))
    impact = (
        (F.col("unit_price") > 0)
        & (F.col("control") != "ecart")
        & ~F.col("is_lump_line")
        & F.col("unit_ok")
    )
    counts = rows.groupBy("item_id", "label_print").agg(
        F.count(F.lit(1)).alias("n_pending"), F.count_if(impact).alias("n_impact")
    )
    done = links.where(F.col("validated")).groupBy("item_id").agg(
        F.count(F.lit(1)).alias("n_validated"),
        F.count_if(F.col("validated_by").isin(*AUTO)).alias("n_auto"),
    )
    first = Window.partitionBy("item_id").orderBy("designation")
    samples = (
        rows.select("item_id", "designation")
        .distinct()
        .withColumn("_n", F.row_number().over(first))
        .where(F.col("_n") <= 3)
        .groupBy("item_id")
        .agg(F.array_sort(F.collect_list("designation")).alias("samples"))
    )
    return (
        counts.join(done, "item_id", "left")
        .join(samples, "item_id", "left")
        .fillna(0, ["n_validated", "n_auto"])
    )


def item_queue_order() -> list[Column]:
    return [F.col("n_impact").desc(), F.col("n_pending").desc(), F.col("label_print"),
            F.col("item_id")]


def item_queue_lines(pending: DataFrame, shown: int = LINES_SHOWN) -> DataFrame:
    """The first pending lines of each item and whether more exist."""
    counts = pending.groupBy("item_id").agg(F.count(F.lit(1)).alias("_pending"))
    recent = Window.partitionBy("item_id").orderBy(
        F.col("document_date").desc_nulls_last(), F.col("ord"), F.col("line_id")
    )
    return (
        pending.withColumn("position", F.row_number().over(recent))
        .where(F.col("position") <= shown)
        .join(counts, "item_id")
        .withColumn("truncated", F.col("_pending") > shown)
        .drop("_pending")
    )


def review_queue(pending: DataFrame) -> DataFrame:
    """Pending lines one by one, with the other pending lines of their item."""
    counted = count_per_key(pending, "item_id", "_same")
    return counted.withColumn("same_item", F.col("_same") - 1).drop("_same")


def review_order() -> list[Column]:
    return [
        F.col("same_item").desc(),
        F.col("item_id"),
        F.col("score").asc_nulls_first(),
        F.col("document_date").asc_nulls_last(),
        F.col("line_id"),
    ]


def pending_groups(pending: DataFrame, minimum: int = 2) -> DataFrame:
    """Lines of active items with at least ``minimum`` pending links (input of an external check)."""
    rows = pending.where(F.col("active"))
    return count_per_key(rows, "item_id", "n_pending").where(F.col("n_pending") >= minimum)


def orphan_queue(lines: DataFrame, links: DataFrame, documents: DataFrame) -> DataFrame:
    """Priced in-scope lines without link, with the number of identical wordings."""
    rows = (
        lines.where(~F.col("is_title") & ~F.col("off_scope") & (F.col("unit_price") > 0))
        .join(links.select("line_id"), "line_id", "left_anti")
        .join(
            documents.where(F.col("status") != "rejete").select("document_id", "document_date"),
            "document_id",
        )
    )
    return count_per_key(rows, "search_text", "n_identical")


def orphan_order() -> list[Column]:
    return [
        F.col("n_identical").desc(),
        F.col("search_text"),
        F.col("document_date").desc_nulls_last(),
        F.col("line_id"),
    ]


def orphan_documents(lines: DataFrame, links: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents with lines still to match, for the matching job (fewest first)."""
    return (
        lines.where(~F.col("is_title") & ~F.col("off_scope"))
        .join(links.select("line_id"), "line_id", "left_anti")
        .join(documents.where(F.col("status") != "rejete").select("document_id"), "document_id",
              "left_semi")
        .groupBy("document_id")
        .agg(F.count(F.lit(1)).alias("n_orphans"))
    )


# ---- C20: proposals and their evidence ------------------------------------------


def proposal_listing(proposals: DataFrame, items: DataFrame, status: str = "proposee") -> DataFrame:
    """Proposals of a status with both items; open ones only while both items are active."""

    def side(name: str) -> DataFrame:
        return items.select(
            F.col("item_id").alias(f"{name}_id"),
            F.col("label_print").alias(f"{name}_label"),
            F.col("item_unit").alias(f"{name}_unit"),
            F.col("active").alias(f"{name}_active"),
        )

    rows = (
        proposals.where(F.col("status") == status)
        .join(side("source"), "source_id")
        .join(side("target"), "target_id")
    )
    if status == "proposee":
        rows = rows.where(F.col("source_active") & F.col("target_active"))
    return rows.drop("source_active", "target_active")


def proposal_order() -> list[Column]:
    return [F.col("score").desc_nulls_last(), F.col("source_label"), F.col("source_id"),
            F.col("target_id")]


def item_evidence(linked_texts: DataFrame) -> DataFrame:
    """Up to three raw wordings of each item, cut before they are gathered."""
    first = Window.partitionBy("item_id").orderBy("designation")
    return (
        linked_texts.select("item_id", "designation")
        .distinct()
        .withColumn("_n", F.row_number().over(first))
        .where(F.col("_n") <= 3)
        .groupBy("item_id")
        .agg(F.array_sort(F.collect_list("designation")).alias("wordings"))
    )


def proposal_evidence(proposals: DataFrame, items: DataFrame, linked_texts: DataFrame) -> DataFrame:
    """Open proposals without verdict, with label, unit and wordings of both sides."""
    described = items.select("item_id", "label_print", "item_unit").join(
        item_evidence(linked_texts), "item_id", "left"
    )

    def side(name: str) -> DataFrame:
        return described.select(
            F.col("item_id").alias(f"{name}_id"),
            F.col("label_print").alias(f"{name}_label"),
            F.col("item_unit").alias(f"{name}_unit"),
            F.col("wordings").alias(f"{name}_wordings"),
        )

    return (
        proposals.where((F.col("status") == "proposee") & F.col("verdict").isNull())
        .join(side("source"), "source_id")
        .join(side("target"), "target_id")
    )


# ---- W5: stratified sample -------------------------------------------------------


def category_sample(items: DataFrame, k: int = 40, seed: int = 20260410) -> DataFrame:
    """At most k active items per category in a seeded pseudo-random order."""
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("item_id").cast("string")).cast("binary"))
    order = Window.partitionBy("category_id").orderBy("_draw", "item_id")
    return (
        items.where(F.col("active"))
        .withColumn("_draw", draw)
        .withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= k)
        .drop("_draw")
    )
