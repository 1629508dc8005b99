import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pricebase.functions.text import search_literal, trigram_literal
from pricebase.operators import dedupe, matching, metric_join, normalize, topk_join, trigram_join

WORDS = ["dalle", "beton", "mur", "pose", "ipn", "160", "200", "depose", "acier", "cloison"]


def texts(n, seed):
    draw = random.Random(seed)
    return [" ".join(draw.choices(WORDS, k=draw.randint(1, 4))) for _ in range(n)]


def sim(a, b):
    x, y = set(trigram_literal(a)), set(trigram_literal(b))
    return len(x & y) / len(x | y) if x | y else 0.0


@pytest.mark.parametrize("limit", [20_000, 3])
def test_trigram_join_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(trigram_join, "POSTING_LIMIT", limit)
    left, right = texts(60, 1), texts(50, 2)
    l = trigram_join.text_side(spark.createDataFrame([(t,) for t in left], "t string"), "t")
    r = trigram_join.text_side(spark.createDataFrame([(t,) for t in right], "t string"), "t")
    for threshold in (0.3, 0.6, 1.0):
        got = trigram_join.trigram_join(l, r, threshold).collect()
        found = {(x.left_id, x.right_id): x.score for x in got}
        assert len(found) == len(got)
        expected = {(a, b): sim(a, b) for a in set(left) for b in set(right) if sim(a, b) >= threshold}
        assert found == pytest.approx(expected)
    pairs = {(x.left_id, x.right_id) for x in trigram_join.trigram_join(l, None, 0.5).collect()}
    assert pairs == {(a, b) for a in set(left) for b in set(left) if a < b and sim(a, b) >= 0.5}


def catalogue(spark, n=40):
    draw = random.Random(5)
    units = ["m2", "ml", "u", None, "forfait"]
    rows = [(i, t, draw.choice(units), draw.random() > 0.1) for i, t in enumerate(texts(n, 4))]
    return rows, spark.createDataFrame(rows, "item_id bigint, label_norm string, item_unit string, active boolean")


def compatible(line, item):
    return item is None or (line is not None and (line == item or {line, item} <= {"ens", "forfait"}))


def wordings(n):
    draw = random.Random(9)
    return [(f"l{i}", t, draw.choice(["m2", "h", None, "ens"]), draw.randrange(40)) for i, t in enumerate(texts(n, 6))]


def test_rule_matching_equals_brute_force(spark):
    rows, items = catalogue(spark)
    lines = wordings(60)
    frame = spark.createDataFrame(lines, "line_id string, search_text string, unit string, item_id bigint").drop("item_id")
    got = {r.line_id: (r.item_id, r.score, r.unit_ok) for r in matching.rule_matching(frame, items).collect()}
    expected = {}
    for line_id, text, unit, _ in lines:
        options = [
            (compatible(unit, u), sim(text, search_literal(label)), -i)
            for i, label, u, active in rows
            if active and sim(text, label) >= 0.45
        ]
        if options:
            ok, score, smallest = max(options)
            expected[line_id] = (-smallest, np.floor(score * 1000 + 0.5) / 1000, ok)
    assert got == expected


def test_alternatives_equal_brute_force(spark):
    rows, items = catalogue(spark)
    lines = wordings(40)
    frame = spark.createDataFrame(lines, "line_id string, search_text string, unit string, item_id bigint")
    got = {}
    for r in matching.match_alternatives(frame, items).orderBy("line_id", "rank").collect():
        got.setdefault(r.line_id, []).append(r.item_id)
    for line_id, text, unit, current in lines:
        options = sorted(
            (not compatible(unit, u), -sim(text, label), i)
            for i, label, u, active in rows
            if active and i != current
        )
        assert got[line_id] == [i for _, _, i in options[:3]]


def test_alternatives_are_always_k_and_units_are_those_of_the_lines(spark):
    schema = "item_id bigint, item_unit string, label_norm string, active boolean"
    items = spark.createDataFrame([(1, "palette", "zzz", True), (2, "kg", "yyy", True), (3, "kg", "www", True), (4, None, "vvv", True)], schema)
    lines = spark.createDataFrame([("a", "qqq", "palette", 1)], "line_id string, search_text string, unit string, item_id bigint")
    got = matching.match_alternatives(lines, items).orderBy("rank").collect()
    assert [(r.item_id, r.ok) for r in got] == [(4, True), (2, False), (3, False)]
    lines = spark.createDataFrame([("a", "vvv", "palette", None)], "line_id string, search_text string, unit string, item_id bigint")
    (found,) = matching.rule_matching(lines.drop("item_id"), items).collect()
    assert (found.item_id, found.unit_ok) == (4, True)


def test_new_codes_are_free(spark):
    items = spark.createDataFrame([(1, "A"), (2, "A-2"), (3, "C-7")], "item_id bigint, code string")
    rows = [(g, None, code, "label", "print", None, None, False, [g]) for g, code in ((1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "b-2"), (6, "c"))]
    groups = spark.createDataFrame(
        rows,
        "group_id bigint, existing_code string, code string, label_norm string, label_print string, category_code string, unit string, is_lump boolean, line_ids array<bigint>",
    )
    lines = spark.range(1, 7).select(F.col("id").alias("line_id"))
    links = spark.createDataFrame([], "line_id bigint")
    categories = spark.createDataFrame([], "category_code string, category_id bigint")
    units = spark.createDataFrame([], "code string")
    made, linked = matching.apply_groupings(groups, lines, links, items, categories, units)
    codes = {r.group_id: r.code for r in made.collect()}
    assert len(set(codes.values()) | {"A", "A-2", "C-7"}) == 9
    assert codes[1] == "A-3" and codes[3] == "B" and codes[5] == "B-2" and codes[6] == "C"
    assert linked.count() == 6


def test_merge_proposals_never_self_and_idempotent(model):
    proposals = dedupe.merge_proposals(model.items(), model.links()).persist()
    assert proposals.count() > 0
    assert proposals.where(F.col("source_id") == F.col("target_id")).count() == 0
    assert dedupe.new_proposals(proposals, proposals).count() == 0
    proposals.unpersist()


def test_newer_item_stays_on_equal_links(spark):
    rows = [(1, "dalle beton", "m2", False, True, 1, "2024-01-01"), (2, "dalle betons", "m2", False, True, 1, "2024-02-01")]
    items = spark.createDataFrame(
        rows, "item_id bigint, label_norm string, item_unit string, is_lump boolean, active boolean, category_id int, created_on string"
    ).withColumn("created_on", F.to_date("created_on"))
    links = spark.createDataFrame([(1, 1), (2, 2)], "line_id bigint, item_id bigint")
    (only,) = dedupe.merge_proposals(items, links).collect()
    assert (only.source_id, only.target_id) == (1, 2)


def test_embedding_pairs_across_tiles(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(60, 8)).astype("float32")
    vectors[10] = vectors[3]
    rows = [(i, i % 2, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows[10] = (10, rows[3][1], rows[3][2])
    frame = spark.createDataFrame(rows, "item_id bigint, block int, embedding array<float>")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in rows}
    expected = {
        (a, b)
        for a, ba, _ in rows for b, bb, _ in rows
        if a < b and ba == bb and 10 not in (a, b) and unit[a] @ unit[b] >= 0.4
    }
    for tile in (2000, 7):
        got = dedupe.embedding_pairs(frame, 0.4, tile).collect()
        assert len(got) == len(expected)
        assert {(r.node_a, r.node_b) for r in got} == expected
    groups = {r.item_id: r.node for r in dedupe.embedding_groups(frame).collect()}
    assert groups[10] == 3


def test_connected_components(spark):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(30)] + [("x", "y"), ("y", "z")]
    frame = spark.createDataFrame(edges, "a string, b string")
    got = {r.node: r.component for r in normalize.connected_components(frame).collect()}
    assert {got[f"n{i:03d}"] for i in range(31)} == {"n000"}
    assert {got["x"], got["y"], got["z"]} == {"x"}


def test_clients_alias_then_similar_then_new(spark):
    clients = spark.createDataFrame([(1, "Residence Croix du Sud"), (2, "SCI Bellevue")], "client_id bigint, name string")
    aliases = spark.createDataFrame([("BV", 2)], "alias string, client_id bigint")
    names = spark.createDataFrame(
        [(n,) for n in ("BV", "Résidence Croi du Sud", "Mairie de Vence", "Mairie de Vences", " ")], "raw_name string"
    )
    matches = normalize.match_clients(names, clients, aliases)
    got = {r.raw_name: (r.client_id, r.method) for r in matches.collect()}
    assert got == {
        "BV": (2, "alias"),
        "Résidence Croi du Sud": (1, "trigramme"),
        "Mairie de Vence": (None, "nouveau"),
        "Mairie de Vences": (None, "nouveau"),
    }
    assert {r.client_key for r in normalize.new_clients(matches).collect()} == {"mairie de vence"}


def test_clients_are_not_paired_with_all_that_share_a_word(spark, monkeypatch):
    """The best of each name is sought by itself, as a comparison of all finds it; ids may be null."""
    monkeypatch.setattr(normalize, "trigram_join", None)
    random.seed(5)
    word = lambda: "".join(random.choices("bactil", k=4))
    known = [(i if i % 9 else None, f"Residence {word()}") for i in range(90)] + [(7, None), (500, "!!"), (3, "beta alpha"), (2, "alpha beta")]
    names = [f"residence {word()}" for _ in range(60)] + ["Alpha Beta", "??", "Mairie"]
    clients = spark.createDataFrame(known, "client_id bigint, name string")
    aliases = spark.createDataFrame([], "alias string, client_id bigint")
    found = normalize.match_clients(spark.createDataFrame([(n,) for n in names], "raw_name string"), clients, aliases)
    got = {r.raw_name: (r.client_id, None if r.score is None else round(r.score, 9)) for r in found.collect()}
    ids: dict[str, list[int]] = {}
    for client, name in known:
        ids.setdefault((name or "").lower(), []).extend([] if client is None else [client])
    for name in names:
        own = set(trigram_literal(name.lower()))
        scored = []
        for label, same in ids.items():
            other = set(trigram_literal(label))
            if own and other and len(own & other) / len(own | other) >= normalize.CLIENT_THRESHOLD:
                scored.append((-len(own & other) / len(own | other), min(same, default=10**9)))
        score, client = min(scored, default=(None, None))
        assert got[name] == (None if client == 10**9 else client, None if score is None else round(-score, 9))


def test_metric_join_against_all_pairs(spark):
    """Clusters, scattered vectors, equal directions and boundary angles, for every number of pivots."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16))
    clustered = [centres[i % 12] + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.4]) for i in range(300)]
    rows = [(i, i % 2, v.tolist()) for i, v in enumerate([*clustered, *rng.normal(size=(60, 16))])]
    rows += [(900, 0, (2 * np.array(rows[0][2])).tolist()), (901, 0, [0.0] * 16), (902, 1, None)]
    frame = spark.createDataFrame(rows, "item_id bigint, block int, embedding array<double>")
    unit = {i: (b, np.array(v) / np.linalg.norm(v)) for i, b, v in rows if v and any(v)}
    for threshold in (0.92, 0.5):
        wanted = {
            (a, b) for a in unit for b in unit
            if a < b and unit[a][0] == unit[b][0] and float(unit[a][1] @ unit[b][1]) >= threshold - 1e-9
        }
        assert len(wanted) > 100
        for tile in (2_000, 9):
            found = dedupe.embedding_pairs(frame, threshold, tile).collect()
            assert len(found) == len(wanted) and {(r.node_a, r.node_b) for r in found} == wanted
    assert dedupe.embedding_pairs(frame.where("block > 5")).count() == 0


def test_pivots_spare_cells_of_clusters():
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 64))
    vectors = np.repeat(centres, 50, 0) + rng.normal(size=(2000, 64)) * 0.1
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    rng.shuffle(vectors)
    reach = float(np.arccos(0.92))
    pivots = metric_join.chosen_pivots(vectors, 10_000_000, reach)
    assert len(pivots) == 256
    _, near = metric_join.visits(metric_join.angles(vectors, pivots), reach)
    assert near.mean() < 0.1  # of all cells, instead of half of them
    assert len(metric_join.chosen_pivots(vectors, 500, reach)) <= 16


def test_scattered_vectors_are_not_copied_into_cells():
    """Cells that exclude nothing cost copies only; what leaves a task stays small either way."""
    rng = np.random.default_rng(10)
    vectors = rng.normal(size=(2048, 64))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    reach = float(np.arccos(0.92))
    assert all(len(metric_join.chosen_pivots(vectors, n, reach)) == 1 for n in (2_000, 1_200_000, 50_000_000))
    batch = pd.DataFrame({"block": "b", "node": range(2048), "unit_vector": list(vectors)})
    routed = list(metric_join._routed(vectors[:256], reach)(iter([batch])))
    assert max(map(len, routed)) <= 10_000 and sum(map(len, routed)) > 100_000
    assert sum(r["member"].sum() for r in routed) == 2048


def test_pairs_of_close_vectors_leave_in_batches(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "PAIRS", 50)
    tile = pd.DataFrame({"unit_vector": list(np.eye(2)[[0] * 300]), "angle": 0.0, "tile": 0, "node": range(300)})
    left = list(metric_join._compare(0.92, 0.4)(("b", 0, 0, 0), iter([tile[:100], tile[100:]])))
    assert len(left) > 1 and sum(map(len, left)) == 300 * 299 // 2


@pytest.mark.parametrize("shard, k, threshold", [(20_000, 3, 0.0), (7, 3, 0.0), (7, 1, 0.45), (50, 40, 0.2)])
def test_topk_join_against_all_pairs(spark, monkeypatch, shard, k, threshold):
    monkeypatch.setattr(topk_join, "SHARD", shard)
    monkeypatch.setattr(topk_join, "GROUP", 11)
    random.seed(k)
    parts = ["dalle", "beton", "dallage", "béton", "x", "poteau", "12", "m2"]
    word = lambda n: " ".join(random.choice(parts) for _ in range(random.randrange(n)))
    pool = [(word(6), b, i) for i, b in enumerate(random.choices("ab", k=150))] + [("dalle beton", "a", i) for i in range(500, 520)]
    asked = sorted({(word(5), b) for b in "abc" for _ in range(40)})
    found = topk_join.topk_join(
        spark.createDataFrame(asked, "text string, block string"),
        spark.createDataFrame(pool, "text string, block string, item_id bigint"), k, threshold,
    ).collect()
    got = {}
    for r in sorted(found, key=lambda r: (-r.score, r.item_id)):
        got.setdefault((r.text, r.block), []).append((r.item_id, round(r.score, 9)))
    for text, block in asked:
        own = set(trigram_literal(text))
        scored = []
        for label, b, i in pool:
            other = set(trigram_literal(label))
            if b == block and own & other and len(own & other) / len(own | other) >= threshold:
                scored.append((-len(own & other) / len(own | other), i))
        assert got.get((text, block), []) == [(i, round(-x, 9)) for x, i in sorted(scored)[:k]]


@pytest.mark.parametrize("k, threshold", [(1, 0.55), (4, 0.0), (2, 0.3)])
def test_shard_answers_as_all_pairs_and_compares_few_texts_whole(monkeypatch, k, threshold):
    draw = random.Random(k)
    word = lambda: "".join(draw.choice("abcd") for _ in range(draw.randrange(3, 8)))
    pool = [" ".join(word() for _ in range(draw.randrange(1, 5))) for _ in range(3_000)]
    codes = {}

    def grams(text):
        return np.array([codes.setdefault(g, len(codes)) for g in trigram_literal(text)], np.int64)

    sets = [grams(t) for t in pool]
    shard = topk_join.Shard(np.concatenate(sets), np.array([len(g) for g in sets]))
    compared = []
    scores = topk_join.Postings._scores
    monkeypatch.setattr(topk_join.Postings, "_scores", lambda self, met, size: (compared.append(len(met)), scores(self, met, size))[1])
    asked = [pool[i] + draw.choice(["", "d", " abc"]) for i in range(0, 3_000, 100)]
    for text in asked:
        own = set(grams(text).tolist())
        all_pairs = np.array([len(own & set(g.tolist())) / len(own | set(g.tolist())) for g in sets])
        met, score = shard.best(grams(text), k, threshold)
        assert np.allclose(score, all_pairs[met]) and len(set(met.tolist())) == len(met)
        wanted = np.lexsort((np.arange(len(pool)), -all_pairs))[:k]
        wanted = [i for i in wanted if all_pairs[i] > 0 and all_pairs[i] >= threshold]
        assert met[np.lexsort((met, -score))[:k]].tolist() == wanted
    assert sum(compared) < 0.2 * len(pool) * len(asked)


def test_shards_hold_texts_of_like_size(spark, monkeypatch):
    monkeypatch.setattr(topk_join, "SHARD", 10)
    pool = spark.createDataFrame([("b", i, list(range(1 + i % 5))) for i in range(50)], "block string, item_id bigint, grams array<bigint>")
    asked = spark.createDataFrame([("b", i, [1]) for i in range(3)], "block string, query bigint, grams array<bigint>")

    def sizes(pool, queries):
        held = [len(g) for g in pool["grams"].to_pylist()]
        return pa.table({"n": [len(held)], "least": [min(held)], "most": [max(held)], "asked": [queries.num_rows]})

    met = topk_join._meetings(topk_join._parts(pool, asked), pool, asked)
    got = met.applyInArrow(sizes, "n bigint, least bigint, most bigint, asked bigint").collect()
    assert sorted((r.least, r.most) for r in got) == [(i, i) for i in range(1, 6)]
    assert all(r.n == 10 and r.asked == 3 for r in got)


def test_vectors_are_copied_to_few_tiles_and_written_compressed(spark):
    """100 000 vectors of 64 numbers in a block fill two tiles, not seven; tables between the steps are Parquet."""
    assert -(-100_000 // (metric_join.TILE_VALUES // 64)) == 2
    rows = [("a", i, [1.0, i / 7]) for i in range(30)]
    frame = spark.createDataFrame(rows, "block string, node bigint, unit_vector array<double>")
    plan = metric_join.cosine_join(frame, 0.99)._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in plan and "LogicalRDD" not in plan
