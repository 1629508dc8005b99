import random
from datetime import date
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import queries
from pricebase.operators import cooccurrence as cooc
from pricebase.operators import fees, quantity, stats
from pricebase.plans import views
from pricebase.plans.filters import PriceFilters


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_levels_add_up(base):
    levels = stats.price_stats_levels(base).persist()
    total = {r.item_id: r.n for r in stats.at_level(levels, "global").collect()}
    by_type = stats.at_level(levels, "type").groupBy("item_id").agg(F.sum("n").alias("n"))
    by_zone = stats.at_level(levels, "zone").groupBy("item_id").agg(F.sum("n").alias("n"))
    assert {r.item_id: r.n for r in by_type.collect()} == total
    assert {r.item_id: r.n for r in by_zone.collect()} == total
    wrong = levels.where(
        ~(
            (F.col("price_min") <= F.col("price_p25") + 0.01)
            & (F.col("price_p25") <= F.col("price_median"))
            & (F.col("price_median") <= F.col("price_p75"))
            & (F.col("price_p75") <= F.col("price_max") + 0.01)
        )
    )
    assert wrong.count() == 0
    levels.unpersist()


def lines_of(spark, rows):
    schema = (
        "item_id long, document_id long, unit_price decimal(14,4), price_indexed decimal(18,4), quantity decimal(14,3), "
        "document_date date, is_extra boolean, zone_id long, zone_reliable boolean"
    )
    return spark.createDataFrame(rows, schema)


def test_statistics_of_counted_lines_match_numpy(spark):
    draw = random.Random(5)
    rows = []
    for i in range(600):
        item, document = draw.choice([1, 1, 1, 2, 3]), draw.randint(1, 60)
        price = Decimal(draw.choice([10, 12, 12.5, 99.9999, draw.randint(1, 9999)])).quantize(Decimal("0.0001"))
        rows.append((item, document, price, None if item == 3 else price * 2, Decimal(1), date(2024, 1, 1 + document % 28), document % 2 == 0, document % 3 or None, None))
    rows += [(4, None, Decimal("7.0000"), None, None, None, False, None, True)] * 3
    got = {r.item_id: r for r in stats.price_stats(lines_of(spark, rows), ["item_id"]).collect()}
    assert set(got) == {1, 2, 3, 4}
    for item, r in got.items():
        prices = np.array([float(x[2]) for x in rows if x[0] == item])
        assert r.n == len(prices) and r.n_documents == len({x[1] for x in rows if x[0] == item} - {None})
        assert r.price_median == pytest.approx(np.median(prices), abs=0.006) and r.price_mean == pytest.approx(prices.mean(), abs=0.006)
        assert r.price_stddev == pytest.approx(prices.std(ddof=1), abs=0.006)
        if item >= 3:
            assert r.indexed_median is None and r.indexed_mean is None
    assert got[4].price_stddev == 0 and got[4].variation == 0
    levels = stats.price_stats_levels(lines_of(spark, rows)).where("level = 'global'").select("item_id", "n", "n_documents", "price_median")
    assert {(r.item_id, r.n, r.n_documents) for r in levels.collect()} == {(i, r.n, r.n_documents) for i, r in got.items()}


def test_one_plan_without_distinct_beside_percentile(base):
    plan = stats.price_stats_levels(base)._jdf.queryExecution().optimizedPlan().toString()
    assert "distinct" not in plan.lower() and plan.count("percentile(") >= 2


def test_quartiles_need_four_lines(base):
    rows = stats.price_stats(base, ["item_id"])
    assert rows.where((F.col("n") < 4) & F.col("price_p25").isNotNull()).count() == 0
    assert rows.where((F.col("n") >= 4) & F.col("price_p25").isNull()).count() == 0


def test_every_zone_is_returned(base, model):
    rows = stats.stats_by_zone(base, model.zones())
    zones = model.zones().count()
    assert rows.groupBy("item_id").count().where(F.col("count") != zones).count() == 0
    assert rows.where((F.col("n") == 0) & ~F.col("insufficient")).count() == 0


def test_reliability_boundaries(spark):
    rows = [(10, 0.249, "haute"), (10, 0.25, "moyenne"), (9, 0.1, "moyenne"), (4, None, "moyenne"), (3, 0.1, "faible")]
    frame = spark.createDataFrame(rows, "n int, v double, expected string")
    got = frame.select(stats.reliability(F.col("n"), F.col("v")).alias("r"), "expected").collect()
    assert [r.r for r in got] == [r.expected for r in got]


def test_period_filter(base):
    rows = stats.price_stats(base, ["item_id"], PriceFilters(since="1997-01-01", until="1997-12-31"))
    bounds = rows.agg(F.min("first_date"), F.max("last_date")).first()
    assert bounds[0] >= "1997-01-01" and bounds[1] <= "1997-12-31"


def test_unknown_unit_never_prices(base):
    assert base.where(F.col("unit").isNull() | F.col("unit").isin("ens", "forfait")).count() == 0


def test_separate_tables_give_the_same_base(base, model):
    linked = views.link_lines(model.lines(), model.links())
    joined = views.aggregable_lines(linked, model.documents(), model.items(), model.units(), model.price_index())
    assert joined.exceptAll(base).count() == 0 and base.exceptAll(joined).count() == 0


def test_fees_keep_items_without_amounts(spark):
    linked = spark.createDataFrame(
        [(i, 1, 1, True, False, "ok", None) for i in range(3)] + [(9, 2, 1, True, False, "ok", Decimal("50.00"))],
        "line_id long, item_id long, document_id long, validated boolean, excluded boolean, control string, total decimal(14,2)",
    )
    documents = spark.createDataFrame([(1, "valide", False, Decimal("1000.00"))], "document_id long, status string, is_extra boolean, document_total decimal(14,2)")
    items = spark.createDataFrame([(1, True), (2, True)], "item_id long, is_lump boolean")
    got = {r.item_id: r for r in fees.site_fees(linked, documents, items).collect()}
    assert got[1].n == 3 and got[1].amount_median is None and got[2].share_median == 5.0


def test_quantity_threshold_against_brute_force(spark):
    draw = random.Random(8)
    rows = []
    for item in range(1, 7):
        for _ in range(draw.choice([5, 9, 60])):
            amount = draw.randint(1, 12)
            price = draw.choice([100, 101, 120]) * (0.8 if amount > 6 and item % 2 else 1.0)
            rows.append((item, Decimal(amount), Decimal(str(round(price, 4))), None))
    points = spark.createDataFrame(rows, "item_id long, quantity decimal(14,3), unit_price decimal(14,4), price_indexed decimal(18,4)")
    got = {r.item_id: (r.threshold, r.median_below, r.median_above, r.n_below, r.n_above) for r in quantity.quantity_threshold(points).collect()}
    wanted = {}
    for item in range(1, 7):
        own = [(float(q), float(p)) for i, q, p, _ in rows if i == item]
        found = []
        for cut in {q for q, _ in own}:
            below, above = [p for q, p in own if q < cut], [p for q, p in own if q >= cut]
            if len(below) >= 4 and len(above) >= 4 and np.median(above) < 0.95 * np.median(below):
                found.append((np.median(below) - np.median(above), -cut, np.median(below), np.median(above), len(below), len(above)))
        if found:
            _, cut, low, high, n_low, n_high = max(found)
            wanted[item] = (-cut, pytest.approx(low), pytest.approx(high), n_low, n_high)
    assert got == wanted and got


def test_cooccurrence_against_brute_force(spark):
    draw = random.Random(12)
    rows = [(draw.randint(1, 25), draw.randint(1, 12), draw.choice([0.0, 1.0, 2.0, 4.0, None])) for _ in range(260)]
    rows += [(99, i, 3.0) for i in range(1, 40)]
    base = spark.createDataFrame(rows, "document_id long, item_id long, quantity double")
    items = {i: {d for d, x, _ in rows if x == i} for i in {x for _, x, _ in rows}}
    wanted = {}
    for a in items:
        for b in items:
            both = items[a] & items[b]
            if a < b and len(both) >= 3:
                ratios = [
                    qb / qa for d, x, qa in rows if x == a and d in both and qa for e, y, qb in rows if y == b and e == d and qb is not None
                ]
                median = float(np.floor(np.median(ratios) * 1000 + 0.5) / 1000) if ratios else None
                wanted[a, b] = (len(both), len(items[a]), len(items[b]), median)
    got = {(r.item_a, r.item_b): (r.n_together, r.n_a, r.n_b, r.ratio_b_over_a) for r in cooc.cooccurrence(base).collect()}
    assert got == wanted and got


def test_pairs_of_a_large_document_spread_over_tiles(spark):
    rows = [(d, i) for d in (1, 2, 3) for i in range(300)] + [(4, 5), (4, 9), (5, 7)]
    frame = spark.createDataFrame(rows, "document_id long, item_id long")
    for tile in (500, 40):
        found = cooc.pairs_within(frame, tile)
        assert found.count() == found.distinct().count() == 3 * 300 * 299 // 2 + 1
        assert found.where("item_a >= item_b").count() == 0
        assert [tuple(r) for r in found.where("document_id = 4").collect()] == [(5, 9, 4)]
    base = frame.withColumn("quantity", F.lit(2.0))
    together = cooc.cooccurrence(base)
    assert together.count() == 300 * 299 // 2 and {r.n_together for r in together.select("n_together").distinct().collect()} == {3, 4}


def test_grid_sorts_missing_last(model):
    from pricebase.operators import grid

    f = PriceFilters(include_unpriced=True)
    rows = grid.price_grid(queries.base(model, False), queries.categorised(model), filters=f)
    for ascending in (True, False):
        keys = [
            r.normal_price_median if r.normal_price_median is not None else r.extra_price_median
            for r in rows.orderBy(*grid.grid_order("price", ascending)).collect()
        ]
        known = [k for k in keys if k is not None]
        assert keys[: len(known)] == sorted(known, reverse=not ascending)
