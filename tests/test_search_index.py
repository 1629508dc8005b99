from pyspark.sql import functions as F

from pricebase.functions.text import padded_words, shared_trigrams, trigram_literal, trigram_sequence
from pricebase.operators import search, search_index
from pricebase.plans import views

TERMS = ["dalle betn", "mur", "a", "C-2", "béton armé", "zzz"]


def test_certain_grams_survive_any_neighbours():
    from pricebase.functions.text import trigram_literal

    for plain in ("mur", "ur be", " mur", "x", "dalle beton "):
        for before, after in (("", ""), ("x", "y"), (" ", " "), ("-", "")):
            assert set(search_index.certain_grams(plain)) <= set(trigram_literal(before + plain + after))


def test_index_search_equals_the_scan_after_a_refresh_and_a_replay(spark, tmp_path):
    labels = ["Dalle béton", "dalle de beton arme", "Mur en parpaing", "mur mur mur", "Pose IPN", "a", "", None]
    rows = [(i, f"C-{i}", label, (label or "x").upper(), "m2", i != 4) for i, label in enumerate(labels)]
    items = spark.createDataFrame(
        rows, "item_id long, code string, label_print string, label_norm string, item_unit string, active boolean"
    )
    linked = spark.createDataFrame(
        [(0, "dalle betom"), (4, "mur"), (5, "beton arme lisse"), (5, "beton arme lisse"), (2, None)],
        "item_id long, search_text string",
    )
    path = str(tmp_path / "index")
    search_index.add_texts(search_index.item_texts(items, linked), path, 0)

    def same(items):
        by_index = search_index.item_search(items, linked, path, TERMS, limit=3).collect()
        assert by_index
        assert sorted(by_index) == sorted(search.item_search(items, linked, TERMS, limit=3).collect())
        return by_index

    same(items)
    touched = items.withColumn(
        "label_print", F.when(F.col("item_id") == 2, "Zzz de dalle betn").otherwise(F.col("label_print"))
    )
    before = search_index.stored_texts(spark, path).count()
    for _ in range(2):  # a replayed batch adds nothing twice
        search_index.add_texts(search_index.item_texts(touched, linked), path, 1)
        assert search_index.stored_texts(spark, path).count() == before + 1
    found = same(touched)
    assert any(r.item_id == 2 and r.term == "zzz" for r in found)


def _compared(monkeypatch) -> list[int]:
    """Numbers of rows that a search spreads over the cores to compare them."""
    seen: list[int] = []
    spread = search.spread
    monkeypatch.setattr(search, "spread", lambda rows: seen.append(rows.count()) or spread(rows))
    return seen


def test_items_of_one_label_are_compared_once(spark, monkeypatch):
    seen = _compared(monkeypatch)
    rows = [(i, f"C-{i}", "Dalle béton", "dalle beton", True) for i in range(50)]
    rows += [(100, "XK-1", None, None, True), (101, "C-9", None, "dalle", True), (102, "C-7", "Dalle béton", "dalle beton", False)]
    rows += [(None, "XK-2", "Poteau", "poteau", True), (104, None, "Mur", "mur", True)]
    items = spark.createDataFrame(rows, "item_id bigint, code string, label_print string, label_norm string, active boolean")
    linked = spark.createDataFrame([(104, "coulage dalle"), (104, "coulage dalle"), (None, "dalle")], "item_id bigint, search_text string")
    found = search.score_items(items, linked, ["dalle", "xk"])
    got = sorted((r.term, r.item_id is None, r.item_id or 0) for r in found.collect())
    assert got == sorted(
        [("dalle", False, i) for i in [*range(50), 101, 104]] + [("xk", False, 100), ("xk", True, 0)]
    )
    assert sorted(seen) == [2, 5]  # wordings, labels


def test_clients_are_spread_before_they_are_compared(spark, monkeypatch):
    seen = _compared(monkeypatch)
    clients = spark.createDataFrame([(i, f"Residence {i}") for i in range(30)], "client_id bigint, name string").coalesce(1)
    aliases = clients.selectExpr("upper(name) AS alias", "client_id")
    documents = spark.createDataFrame([(1, 7, 5.0)], "document_id bigint, client_id bigint, document_total double")
    assert search.client_search(clients, aliases, documents, ["residence 7"], 1).first().client_id == 7
    assert sorted(seen) == [30, 30]


def test_lines_of_one_wording_are_compared_once(spark, monkeypatch):
    seen = _compared(monkeypatch)
    rows = [(i, "dalle beton", None, None) for i in range(20)] + [(50, None, "SCI Dalle", None), (51, None, None, "mur"), (52, "mur", None, None)]
    history = spark.createDataFrame(rows, "line_id bigint, search_text string, client string, item_label string")
    found = search.search_lines(history, "dale")
    assert found.columns == history.columns
    assert sorted(r.line_id for r in found.collect()) == list(range(20))
    assert sorted(r.line_id for r in search.search_lines(history, "dalle").collect()) == [*range(20), 50]
    assert seen == [3, 3]


def test_shared_trigrams_are_those_of_the_arrays(spark):
    texts = ["Béton  armé-lissé", "a", "  ", "", None, "ab.a ring_2 ²", "small ring", "ring small r", "𝒜x ÉTÉ œuf"]
    terms = ["small ring", "a", "été b", "armé 2", "", "in", "𝒜x"]
    rows = spark.createDataFrame([(t, x, trigram_literal(x)) for t in texts for x in terms], "text string, term string, grams array<string>")
    found = rows.select(
        "text", "term", shared_trigrams(F.col("grams"), padded_words(F.col("text"))).alias("cheap"),
        F.size(F.array_intersect("grams", trigram_sequence(F.col("text")))).alias("full"),
    )
    for row in found.collect():
        assert row["cheap"] == row["full"] or row["text"] is None and row["cheap"] is None, row


def test_trigrams_are_built_only_of_texts_that_pass_the_bound(spark):
    """The terms are met, and the bound is checked, below the step that builds a text's trigrams."""
    texts = spark.createDataFrame([(1, "small ring"), (2, "blue bolt")], "item_id long, search_text string")
    clients = texts.select(F.col("item_id").alias("client_id"), F.col("search_text").alias("name"))
    aliases = clients.withColumnRenamed("name", "alias")
    documents = spark.createDataFrame([(1, 10)], "client_id long, document_total long")
    for rows in (
        search.item_ids_by_wording(texts, ["smal ring"], 0.4),
        search.client_search(clients, aliases, documents, ["smal ring"]),
    ):
        plan = rows._jdf.queryExecution().optimizedPlan().toString().splitlines()
        built = [i for i, line in enumerate(plan) if "split(" in line]
        met = [i for i, line in enumerate(plan) if "Generate explode" in line]
        assert built and met and max(built) < max(met)
    assert [r["client_id"] for r in search.client_search(clients, aliases, documents, ["smal ring"]).collect()] == [1]


def test_lines_of_the_history_move_for_documents_and_links_only(spark):
    lines = spark.createDataFrame(
        [("l1", 1, "mur", "mur", False), ("l2", 1, "dalle", "dalle", False), ("l3", 2, "x", "x", False), ("l4", 9, "x", "x", False), ("l5", 2, "t", "t", True)],
        "line_id string, document_id int, designation string, search_text string, is_title boolean",
    )
    documents = spark.createDataFrame([(1, 7, 3), (2, None, None), (2, 8, 3)], "document_id int, client_id int, zone_id int")
    links = spark.createDataFrame([("l1", 5), ("l1", 6), ("l3", None)], "line_id string, item_id int")
    items = spark.createDataFrame([(5, "Mur gizom", 1), (5, "Mur", None)], "item_id int, label_print string, category_id int")
    categories = spark.createDataFrame([(1, "Gros")], "category_id int, category_label string")
    clients = spark.createDataFrame([(7, "SCI Dalle"), (8, "Gizom")], "client_id int, name string")
    zones = spark.createDataFrame([(3, "Z", "Zone")], "zone_id int, zone_code string, zone_label string")
    rows = views.history(lines, documents, links, items, categories, clients, zones)
    got = sorted((r.line_id, r.client or "", r.item_label or "", r.category_label or "", r.zone_code or "") for r in rows.collect())
    assert got == [
        ("l1", "SCI Dalle", "", "", "Z"), ("l1", "SCI Dalle", "Mur", "", "Z"), ("l1", "SCI Dalle", "Mur gizom", "Gros", "Z"),
        ("l2", "SCI Dalle", "", "", "Z"), ("l3", "", "", "", ""), ("l3", "Gizom", "", "", "Z"),
    ]
    assert sorted(r.line_id for r in search.search_lines(rows, "gizom").collect()) == ["l1", "l3"]
    node, joins = rows._jdf.queryExecution().analyzed(), 0
    while node.children().size():
        joins += node.nodeName() == "Join"
        node = node.children().head()
    assert joins == 2
