import datetime as dt

import pytest
from pyspark.sql import functions as F

from pricebase.operators import curation, tree

LINK = (
    "link_id string, line_id string, item_id bigint, score decimal(4,3), method string, validated boolean,"
    " validated_by string, validated_on date, excluded boolean, exclusion_reason string"
)
AT = dt.datetime(2026, 4, 10, 12)


@pytest.fixture
def links(spark):
    rows = [
        ("a", "a", 1, None, "regle", False, None, None, False, None),
        ("b", "b", 1, None, "regle", True, "calage", dt.date(2026, 1, 1), False, None),
        ("c", "c", 2, None, "llm", False, None, None, False, None),
    ]
    return spark.createDataFrame(rows, LINK)


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(1, True), (2, True), (3, True)], "item_id bigint, active boolean")


@pytest.fixture
def no_proposals(spark):
    return spark.createDataFrame([], "source_id bigint, target_id bigint, status string")


def state(links):
    return {r.link_id: (r.item_id, r.method, r.validated, r.validated_by) for r in links.collect()}


def commands(spark, rows):
    return spark.createDataFrame(
        [(link, "g1", item, "me", AT) for link, item in rows],
        "link_id string, batch_id string, new_item_id bigint, actor string, at timestamp",
    )


def test_validate_then_undo(spark, links, items, no_proposals):
    after, journal = curation.bulk_validate(links, commands(spark, [("a", None), ("b", None), ("c", 3)]))
    assert state(after) == {
        "a": (1, "regle", True, "me"), "b": (1, "regle", True, "calage"), "c": (3, "manuel", True, "me")
    }
    assert {r.link_id: r.action for r in journal.collect()} == {"a": "valider", "c": "modifier"}
    again, nothing = curation.bulk_validate(after, commands(spark, [("a", None), ("c", 3)]))
    assert nothing.count() == 0 and state(again) == state(after)
    back, _, _, log = curation.undo_last(after, items, no_proposals, journal)
    assert state(back) == state(links)
    assert log.where(F.col("undone_at").isNull()).count() == 0
    assert curation.last_gestures(log).count() == 0


def test_attach_then_undo_removes_new_links(spark, links, items, no_proposals):
    attach = spark.createDataFrame(
        [("a", 2, "g1", "me", AT), ("z", 2, "g1", "me", AT)],
        "line_id string, target_item_id bigint, batch_id string, actor string, at timestamp",
    )
    after, journal = curation.attach_lines(links, attach)
    assert state(after)["z"] == (2, "manuel", True, "me")
    back, _, _, _ = curation.undo_last(after, items, no_proposals, journal)
    assert state(back) == state(links)


def test_created_item_without_links_is_switched_off(spark, links, items, no_proposals):
    attach = spark.createDataFrame(
        [("z", 3, "g1", "me", AT, 3)],
        "line_id string, target_item_id bigint, batch_id string, actor string, at timestamp, created_item_id bigint",
    )
    after, journal = curation.attach_lines(links, attach)
    _, left, _, _ = curation.undo_last(after, items, no_proposals, journal)
    assert {r.item_id: r.active for r in left.collect()} == {1: True, 2: True, 3: False}


def test_merge_resolves_chains_and_comes_back(spark, links, items):
    proposals = spark.createDataFrame(
        [(1, 2, "proposee"), (2, 3, "proposee"), (1, 3, "refusee")], "source_id bigint, target_id bigint, status string"
    )
    merges = spark.createDataFrame([(1, 2), (2, 3)], "source_id bigint, target_id bigint")
    after, gone, left, journal = curation.merge_items(links, items, proposals, merges)
    assert {v[0] for v in state(after).values()} == {3}
    assert {r.item_id: r.active for r in gone.collect()} == {1: False, 2: False, 3: True}
    assert sorted(r.status for r in left.collect()) == ["obsolete", "obsolete", "refusee"]
    back, on, _, _ = curation.undo_last(after, gone, left, journal)
    assert state(back) == state(links)
    assert all(r.active for r in on.collect())


def test_gestures_of_all_kinds_are_undone_from_one_journal(spark, links, items, no_proposals):
    later = AT + dt.timedelta(hours=1)
    first, one = curation.bulk_validate(links, commands(spark, [("a", 3)]))
    attach = spark.createDataFrame(
        [("a", 2, "g2", "me", later)], "line_id string, target_item_id bigint, batch_id string, actor string, at timestamp"
    )
    second, two = curation.attach_lines(first, attach)
    journal = one.unionByName(two)
    back, _, _, log = curation.undo_last(second, items, no_proposals, journal)
    assert state(back) == state(first) and log.where("undone_at is null").count() == 1
    back, _, _, _ = curation.undo_last(second, items, no_proposals, journal, 2)
    assert state(back) == state(links)


def test_latest_of_several_targets_counts_and_the_others_are_reported(spark, links, items, no_proposals):
    rows = [(1, 2, "g1", "me", AT), (1, 3, "g2", "you", AT + dt.timedelta(hours=1))]
    merges = spark.createDataFrame(rows, "source_id bigint, target_id bigint, batch_id string, actor string, at timestamp")
    after, _, _, journal = curation.merge_items(links, items, no_proposals, merges)
    assert 1 not in {v[0] for v in state(after).values()} and {(r.batch_id, r.actor) for r in journal.collect()} == {("g2", "you")}
    assert [tuple(r) for r in curation.conflicting_merges(merges).collect()] == [(1, 2, 3)]
    undated = curation.conflicting_merges(merges.select("source_id", "target_id")).collect()
    assert [(r.target_id, r.kept_target_id) for r in undated] == [(3, 2)]


def test_merge_cycle_is_refused(spark):
    merges = spark.createDataFrame([(1, 2), (2, 1)], "source_id bigint, target_id bigint")
    with pytest.raises(ValueError, match="cycle"):
        curation.resolve_chains(merges, 5)


def test_auto_validation_is_idempotent(model):
    linked, documents, items = model.linked_lines(), model.documents(zoned=False), model.items()
    found = curation.auto_validation_candidates(linked, documents, items)
    assert found.count() > 0
    todo = found.select(
        "link_id", F.lit("g").alias("batch_id"), F.lit(None).cast("bigint").alias("new_item_id"),
        F.lit("auto").alias("actor"), F.lit(AT).alias("at"),
    )
    after, _ = curation.bulk_validate(model.links(), todo)
    relinked = model.lines().join(after, "line_id")
    assert curation.auto_validation_candidates(relinked, documents, items).count() == 0


def test_document_edits_and_rejection(spark):
    documents = spark.createDataFrame(
        [(1, "valide", None, False, None), (2, "valide", 5, False, None)],
        "document_id bigint, status string, zone_id bigint, zone_reliable boolean, date_source string",
    )
    edits = spark.createDataFrame(
        [(1, AT, None, 4), (1, AT + dt.timedelta(hours=1), "rejete", None)],
        "document_id bigint, at timestamp, status string, zone_id bigint",
    )
    got = {r.document_id: (r.status, r.zone_id, r.zone_reliable) for r in curation.apply_document_edits(documents, edits).collect()}
    assert got == {1: ("rejete", 4, True), 2: ("valide", 5, False)}


def test_exclusion_and_reinstatement(spark, links):
    changes = [("a", AT, True, "faux"), ("b", AT, True, "faux"), ("b", AT + dt.timedelta(1), False, None)]
    frame = spark.createDataFrame(changes, "line_id string, at timestamp, exclude boolean, reason string")
    got = {r.link_id: (r.excluded, r.exclusion_reason) for r in curation.apply_exclusions(links, frame).collect()}
    assert got == {"a": (True, "faux"), "b": (False, None), "c": (False, None)}


def test_category_tree(spark):
    rows = [(1, "A", None, 1), (2, "B", 1, 1), (3, "C", 2, 1), (4, "D", 77, 2)]
    categories = spark.createDataFrame(rows, "category_id int, category_code string, parent_id int, category_ord int")
    closure = {(r.ancestor_id, r.descendant_id) for r in tree.category_closure(categories).collect()}
    assert closure == {(1, 1), (2, 2), (3, 3), (4, 4), (1, 2), (2, 3), (1, 3)}
    assert {r.category_id for r in tree.descendants(categories, 2).collect()} == {2, 3}
    moves = spark.createDataFrame([(1, 3), (3, 1), (2, 2)], "category_id int, new_parent_id int")
    assert {(r.category_id, r.allowed) for r in tree.move_checks(moves, categories).collect()} == {(1, False), (3, True), (2, False)}


def test_identical_orphans_of_a_hot_wording_stay_linear(spark):
    """Half of all lines share one wording, and half of those are chosen."""
    rows = [(i, "hot" if i % 2 else f"w{i % 50}", False, 10.0) for i in range(2000)] + [(9000, "hot", True, 1.0), (9001, None, False, 1.0)]
    lines = spark.createDataFrame(rows, "line_id long, search_text string, is_title boolean, unit_price double")
    links = lines.where("line_id < 100").select("line_id")
    chosen = lines.where("line_id % 4 = 1").select("line_id")
    found = curation.identical_orphans(lines, links, chosen).collect()
    assert len(found) == 500  # the chosen line without wording is like no other
    assert {r.n_identical for r in found if r.search_text == "hot"} == {950}
    commands = chosen.where("line_id < 1000").select(
        "line_id", (F.col("line_id") * 10).alias("target_item_id"), F.lit("b").alias("batch_id"), F.lit("u").alias("actor"), F.col("line_id").alias("at")
    )
    attached = curation.identical_commands(lines, links, commands).collect()
    assert len(attached) == len({r.line_id for r in attached}) == 950 - commands.where("line_id >= 100").count()
    assert {r.target_item_id for r in attached} == {9970}


def test_a_chain_of_categories_is_accepted_in_one_call(spark):
    fields = "category_id int, category_code string, category_label string, parent_id int, category_ord int"
    categories = spark.createDataFrame([(5, "A", "a", None, 1)], fields)
    rows = [("A.1", "A", "propose"), ("A.11", "A.1", "propose"), ("A.111", "A.11", "refuse"), ("A.1111", "A.111", "propose"), ("B", None, "propose"), ("C.1", "C", "propose"), ("D", "D", "propose"), ("E", "A", "propose")]
    proposals = spark.createDataFrame([(c, c.lower(), p, 1, s) for c, p, s in rows], "code string, label string, parent_code string, ord int, status string")
    accepted = proposals.where("code <> 'E'")
    after, made, blocked = curation.accept_categories(proposals, categories, accepted)
    ids = {r.category_code: (r.category_id, r.parent_id) for r in made.collect()}
    assert ids == {"A": (5, None), "A.1": (6, 5), "A.11": (7, 6), "A.111": (8, 7), "A.1111": (9, 8), "B": (10, None)}
    assert {r.code: r.status for r in after.collect()} == {c: "propose" if c in ("C.1", "D", "E") else "accepte" for c, _, _ in rows}
    assert {r.code for r in blocked.collect()} == {"C.1", "D"}
    # once accepted, a proposal is not created again; a child may still follow it
    again, same, _ = curation.accept_categories(after, made, accepted)
    assert same.count() == made.count() and again.where("category_id is null").count() == 3
    fresh = spark.createDataFrame([("B", "new b", None, 2), ("F", "f", None, 3)], "code string, label string, parent_code string, ord int")
    replaced = {r.code: r.status for r in curation.replaced_proposals(after, fresh, "code").collect()}
    assert replaced == {"A.1": "accepte", "A.11": "accepte", "A.111": "accepte", "A.1111": "accepte", "B": "propose", "F": "propose"}


def test_merge_commands_are_searched_once(spark, links, items, no_proposals):
    """The commands may be the result of a long search: all four outputs share one run of it."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    merges = spark.createDataFrame([(1, 2), (2, 3)], "source_id long, target_id long")
    merges = merges.mapInPandas(counted, merges.schema)
    for table in curation.merge_items(links, items, no_proposals, merges):
        table.collect()
    assert seen.value == 2
