"""DuckDB statements equivalent to the registered queries, written on their own in plain SQL."""

from __future__ import annotations


from pricebase.functions.text import ACCENTED, ADMINISTRATIVE_WORDINGS, PLAIN
from pricebase.sources.dims import UNIT_ALIASES, UNIT_LABELS, ZONE_TOWNS


def _values(rows) -> str:
    def cell(v):
        if v is None:
            return "NULL"
        return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)


def plain(x: str) -> str:
    inner = f"translate(lower({x}), '{ACCENTED}', '{PLAIN}')"
    return f"replace(replace(replace({inner}, 'œ', 'oe'), 'æ', 'ae'), 'ß', 'ss')"


def seq(x: str) -> str:
    """Trigrams in reading order."""
    words = f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return (
        f"flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), "
        "lambda i: substr('  ' || w || ' ', i, 3))))"
    )


def tri(x: str) -> str:
    return f"list_distinct({seq(x)})"


def jac(a: str, b: str) -> str:
    m = f"len(list_intersect({a}, {b}))"
    return f"(CASE WHEN len({a}) + len({b}) - {m} > 0 THEN {m} / (len({a}) + len({b}) - {m})::DOUBLE ELSE 0.0 END)"


def wsim(t: str, s: str) -> str:
    """Best run of the sequence s against the set t, over every start and end."""
    run = f"list_distinct(list_slice({s}, i, j))"
    return (
        f"coalesce(list_max(flatten(list_transform(list_filter(range(1, len({s}) + 1), lambda i: list_contains({t}, {s}[i])), "
        f"lambda i: list_transform(list_filter(range(i, len({s}) + 1), lambda j: list_contains({t}, {s}[j])), "
        f"lambda j: {jac(t, run)})))), 0.0)"
    )


def half(x: str, n: int) -> str:
    return f"floor(({x})::DOUBLE * {10**n}.0 + 0.5) / {10**n}.0"


LINE_ID = (
    "md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT, "
    "round(l_extendedprice * 100)::BIGINT, round(l_discount * 100)::BIGINT, round(l_tax * 100)::BIGINT, "
    "l_returnflag, l_linestatus, l_shipdate::DATE::VARCHAR))"
)


def unit_of(x: str) -> str:
    return f"(['m2', 'ml', 'm3', 'u', 'kg', 'forfait'])[({x} % 6) + 1]"


def client_name(key: str) -> str:
    return (
        f"(['SCI ', 'Residence ', 'Copropriete ', 'Cabinet '])[(({key}) % 4) + 1] || "
        f"translate(lpad(((({key}) * 7919 + 104729) % 1000003)::VARCHAR, 7, '0'), '0123456789', 'bactilmonr')"
    )


def compatible(line: str, item: str) -> str:
    return (
        f"({item} IS NULL OR ({line} IS NOT NULL AND ({line} = {item} OR "
        f"({line} IN ('ens', 'forfait') AND {item} IN ('ens', 'forfait')))))"
    )


LABEL = "p_name || ' ' || replace(p_brand, '#', ' ') || ' ' || lower(p_type)"
ADMIN = "|".join(ADMINISTRATIVE_WORDINGS)

PRELUDE = f"""
m_li AS (SELECT *, l_orderkey * 7 + l_partkey * 3 + l_linenumber AS k FROM lineitem),
m_lines AS (
  SELECT k, {LINE_ID} AS line_id, l_orderkey AS document_id, l_linenumber AS ord, l_partkey AS source_item_id,
    l_quantity::DECIMAL(14,3) AS quantity,
    (floor(l_extendedprice / l_quantity * 10000 + 0.5) / 10000)::DECIMAL(14,4) AS unit_price,
    l_extendedprice::DECIMAL(14,2) AS total,
    CASE WHEN k % 10 = 0 THEN NULL WHEN k % 14 = 3 THEN 'h' WHEN k % 29 = 5 THEN 'ens' ELSE {unit_of('l_partkey')} END AS unit,
    k % 31 = 0 AS is_title,
    CASE WHEN l_discount >= 0.09::DOUBLE THEN 'ecart' ELSE 'ok' END AS control,
    1.0::DOUBLE - l_discount AS confidence,
    k % 37 = 0 AS off_scope,
    CASE WHEN k % 37 = 0 THEN CASE WHEN k % 2 = 1 THEN 'llm' ELSE 'humain:calage' END END AS off_scope_reason,
    l_partkey AS item_id, ((k % 60) + 40) / 100.0::DOUBLE AS score,
    CASE k % 3 WHEN 0 THEN 'regle' WHEN 1 THEN 'llm' ELSE 'manuel' END AS method,
    l_returnflag <> 'N' AS validated,
    CASE WHEN l_returnflag <> 'N' THEN CASE k % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'auto-llm' ELSE 'calage' END END AS validated_by,
    CASE WHEN l_returnflag <> 'N' THEN l_shipdate::DATE END AS validated_on,
    l_tax >= 0.08::DOUBLE AS excluded,
    CASE WHEN l_tax >= 0.08::DOUBLE THEN 'aberrant' END AS exclusion_reason,
    l_partkey % 50 <> 13 AS linked
  FROM m_li),
m_linked AS (SELECT *, line_id AS link_id FROM m_lines WHERE linked),
m_label AS (SELECT p_partkey, {LABEL} AS label FROM part),
m_worded AS (
  SELECT *, {plain('designation')} AS search_text FROM (
    SELECT l.*, CASE WHEN k % 35 = 5 THEN 'Retenue de garantie ' || label WHEN k % 35 = 12 THEN 'Option ' || label
      WHEN k % 7 = 0 THEN upper(label) WHEN k % 7 = 1 THEN 'Fourniture et pose ' || label
      WHEN k % 7 = 2 THEN replace(label, 'in', 'ni') WHEN k % 7 = 3 THEN replace(label, 'e', 'é')
      WHEN k % 7 = 4 THEN label || ' compris' ELSE label END AS designation
    FROM m_lines l JOIN m_label ON p_partkey = source_item_id)),
m_places AS (
  SELECT c_custkey, CASE WHEN c_custkey % 37 <> 0 THEN n_regionkey END AS zone_id,
    (c_custkey % 37 <> 0 AND c_mktsegment <> 'HOUSEHOLD') AS zone_reliable
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
m_docs AS (
  SELECT o_orderkey AS document_id, CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE o_orderdate::DATE END AS document_date,
    o_orderpriority = '1-URGENT' AS is_extra,
    CASE o_orderstatus WHEN 'P' THEN 'rejete' WHEN 'O' THEN 'a_revoir' ELSE 'valide' END AS status,
    o_totalprice::DECIMAL(14,2) AS document_total, CASE WHEN o_custkey % 43 = 0 THEN NULL ELSE o_custkey END AS client_id,
    'DEV-' || o_orderkey AS number, (['devis', 'facture', 'situation', 'avenant', 'indetermine'])[(o_orderkey % 5) + 1] AS type,
    'Chantier ' || o_custkey AS site_title, o_orderdate::DATE AS created_on, zone_id, zone_reliable
  FROM orders LEFT JOIN m_places ON o_custkey = c_custkey),
m_zones AS (SELECT r_regionkey AS zone_id, r_name AS zone_code, 'Zone ' || r_name AS zone_label FROM region),
m_clients AS (SELECT c_custkey AS client_id, {client_name('c_custkey')} AS name FROM customer),
m_months AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS mon FROM orders),
m_index AS (
  SELECT mon, (100 + n * 0.25)::DECIMAL(10,4) AS coefficient
  FROM (SELECT mon, (year(mon) - 1995) * 12 + month(mon) - 1 AS n FROM m_months) WHERE n % 17 <> 5),
m_latest AS (SELECT max_by(coefficient, mon)::DOUBLE AS latest FROM m_index),
m_items AS (
  SELECT p_partkey AS item_id, 'P-' || p_partkey AS code, {LABEL} AS label_print, lower({LABEL}) AS label_norm,
    CASE WHEN p_size = 50 THEN NULL ELSE {unit_of('p_partkey')} END AS item_unit, p_partkey % 6 = 5 AS is_lump,
    substr(p_brand, 7)::INT + 100 AS category_id, p_size <> 7 AS active, (DATE '2020-01-01' + p_size) AS created_on
  FROM part),
m_cats AS (
  SELECT * FROM (VALUES (1, 'R', 'Root', NULL::INT, 1), (10, 'G0', 'Group 0', 1, 1), (11, 'G1', 'Group 1', 1, 2),
    (12, 'G2', 'Group 2', 1, 3), (13, 'G3', 'Group 3', 1, 4), (14, 'G4', 'Group 4', 1, 5))
    AS t(category_id, category_code, category_label, parent_id, category_ord)
  UNION ALL
  SELECT n + 100, 'B' || n, 'Brand ' || n, CASE WHEN n = 25 THEN 99 ELSE n % 5 + 10 END, n
  FROM (SELECT DISTINCT substr(p_brand, 7)::INT AS n FROM part)),
m_base AS (
  SELECT l.line_id, l.item_id, document_id, document_date, is_extra, zone_id, zone_reliable, client_id, quantity, unit_price,
    l.total, unit, (floor(unit_price::DOUBLE * (latest / coalesce(coefficient::DOUBLE, 1.0)) * 10000.0 + 0.5) / 10000.0)::DECIMAL(18,4) AS price_indexed,
    mon IS NOT NULL AS month_found, d.status, control
  FROM m_linked l JOIN m_docs d USING (document_id) JOIN m_items i ON i.item_id = l.item_id
  LEFT JOIN m_index ON mon = date_trunc('month', document_date), m_latest
  WHERE d.status <> 'rejete' AND control <> 'ecart' AND validated AND NOT excluded AND NOT is_title AND unit_price > 0
    AND NOT i.is_lump AND unit NOT IN ('ens', 'forfait')),
m_zbase AS (SELECT b.*, zone_code FROM m_base b LEFT JOIN m_zones USING (zone_id))
"""


def with_prelude(sql: str, more: str = "", recursive: bool = False) -> str:
    extra = f",\n{more}" if more else ""
    return f"WITH {'RECURSIVE ' if recursive else ''}{PRELUDE}{extra}\n{sql}"


ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str, more: str = "", recursive: bool = False) -> None:
    ORACLES[name] = with_prelude(sql, more, recursive)


# ---- prices -----------------------------------------------------------------------------------

oracle(
    "aggregable_lines",
    """SELECT line_id, item_id, document_id, document_date::VARCHAR AS document_date, is_extra, zone_id::DOUBLE AS zone_id,
    zone_reliable::VARCHAR AS zone_reliable, client_id::DOUBLE AS client_id, quantity::DOUBLE AS quantity,
    unit_price::DOUBLE AS unit_price, total::DOUBLE AS total, unit, price_indexed::DOUBLE AS price_indexed, month_found, status, control FROM m_base""",
)
oracle(
    "quantity_points",
    "SELECT line_id, item_id, quantity::DOUBLE AS quantity, unit_price::DOUBLE AS unit_price, price_indexed::DOUBLE AS price_indexed FROM m_base WHERE quantity > 0",
)


def q(expr: str, p: float) -> str:
    """Percentile over fixed-point integers, back to two decimals."""
    return f"floor(quantile_cont(({expr} * 10000)::BIGINT, {p}) / 100.0 + 0.5) / 100.0"


def m2(x: str) -> str:
    """A four-decimal value to two decimals, through its fixed-point integer."""
    return f"floor(({x} * 10000)::BIGINT / 100.0 + 0.5) / 100.0"


MEAN = "(sum(unit_price)::DOUBLE / count(*))"
MEANI = "(sum(price_indexed)::DOUBLE / count(*))"
SD = "stddev_samp(unit_price::DOUBLE)"
oracle(
    "price_stats_levels",
    f"""SELECT item_id, is_extra::VARCHAR AS is_extra, zone_id::DOUBLE AS zone_id,
    CASE WHEN grouping(zone_id) = 0 THEN 'zone' WHEN grouping(is_extra) = 0 THEN 'type' ELSE 'global' END AS level,
    count(*) AS n, count(DISTINCT document_id) AS n_documents, min(unit_price)::DOUBLE AS price_min, max(unit_price)::DOUBLE AS price_max,
    {half(MEAN, 2)} AS price_mean, {q('unit_price', 0.25)} AS price_p25, {q('unit_price', 0.5)} AS price_median, {q('unit_price', 0.75)} AS price_p75,
    {half(SD, 2)} AS price_stddev, {half(SD + ' / ' + MEAN, 3)} AS variation, {q('price_indexed', 0.5)} AS indexed_median,
    {half(MEANI, 2)} AS indexed_mean, min(document_date)::VARCHAR AS first_date, max(document_date)::VARCHAR AS last_date,
    sum(quantity)::DOUBLE AS quantity_total, bool_and(zone_reliable)::VARCHAR AS zone_always_reliable,
    CASE WHEN count(*) >= 10 AND coalesce({SD} / {MEAN}, 1) < 0.25 THEN 'haute' WHEN count(*) >= 4 THEN 'moyenne' ELSE 'faible' END AS reliability
    FROM m_base GROUP BY GROUPING SETS ((item_id, is_extra, zone_id), (item_id, is_extra), (item_id))""",
)


def block(keys: str, source: str, where: str = "true") -> str:
    """The on-the-fly statistics block."""
    return f"""SELECT {keys}, n, n_documents, price_min, price_max, price_mean, price_median,
      CASE WHEN n >= 4 THEN p25 END AS price_p25, CASE WHEN n >= 4 THEN p75 END AS price_p75, price_stddev, variation,
      indexed_median, indexed_mean, indexed_min, indexed_max, CASE WHEN n >= 4 THEN i25 END AS indexed_p25, CASE WHEN n >= 4 THEN i75 END AS indexed_p75,
      first_date, last_date, quantity_total,
      CASE WHEN n >= 10 AND variation < 0.25 THEN 'haute' WHEN n >= 4 THEN 'moyenne' ELSE 'faible' END AS reliability, zone_always_reliable
    FROM (SELECT {keys}, count(*) AS n, count(DISTINCT document_id) AS n_documents, {m2('min(unit_price)')} AS price_min, {m2('max(unit_price)')} AS price_max,
      {half(MEAN, 2)} AS price_mean, {q('unit_price', 0.5)} AS price_median, {q('unit_price', 0.25)} AS p25, {q('unit_price', 0.75)} AS p75,
      {half(SD, 2)} AS price_stddev, {half(SD + ' / ' + MEAN, 3)} AS variation, {q('price_indexed', 0.5)} AS indexed_median, {half(MEANI, 2)} AS indexed_mean,
      {m2('min(price_indexed)')} AS indexed_min, {m2('max(price_indexed)')} AS indexed_max, {q('price_indexed', 0.25)} AS i25, {q('price_indexed', 0.75)} AS i75,
      min(document_date)::VARCHAR AS first_date, max(document_date)::VARCHAR AS last_date, sum(quantity)::DOUBLE AS quantity_total,
      bool_and(zone_reliable)::VARCHAR AS zone_always_reliable
      FROM {source} WHERE {where} GROUP BY {keys})"""


IN_PERIOD = "document_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND zone_code IN ('ASIA', 'EUROPE')"
oracle("price_stats_filtered", block("item_id", "m_zbase", f"{IN_PERIOD} AND NOT is_extra"))
ITEM = f"s AS ({block('item_id', 'm_base')})"
BY_TYPE = f"s AS ({block('item_id, is_extra', 'm_base')})"
oracle(
    "stats_by_zone",
    """SELECT s.item_id, zone_code, zone_label, coalesce(p.n, 0) AS n, coalesce(p.n_documents, 0) AS n_documents, p.price_median AS median,
    p.reliability, CASE WHEN s.price_median > 0 THEN floor((p.price_median / s.price_median - 1.0) * 1000.0 + 0.5) / 10.0 END AS gap_percent,
    coalesce(p.n, 0) < 3 AS insufficient FROM s CROSS JOIN m_zones z LEFT JOIN per p ON p.item_id = s.item_id AND p.zone_id = z.zone_id""",
    f"{ITEM}, per AS ({block('item_id, zone_id', 'm_base', 'zone_id IS NOT NULL')})",
)
oracle(
    "line_outliers",
    """SELECT line_id, item_id, unit_price::DOUBLE AS price, price_median AS median, price_stddev AS stddev FROM m_base JOIN s USING (item_id)
    WHERE price_stddev > 0 AND abs(unit_price::DOUBLE - price_median) > 2 * price_stddev""",
    ITEM,
)
oracle(
    "display_bounds",
    """SELECT item_id, price_min AS lower_bound, CASE WHEN price_p25 IS NOT NULL AND price_max > price_p75 * 3 THEN price_p75 * 1.5::DOUBLE ELSE price_max END AS upper_bound,
    coalesce(price_p25 IS NOT NULL AND price_max > price_p75 * 3, false) AS truncated FROM s""",
    ITEM,
)
oracle("common_scale", "SELECT item_id, min(price_min) AS scale_min, max(price_max) AS scale_max FROM s GROUP BY item_id", BY_TYPE)
oracle(
    "deduced_zone_documents",
    "SELECT item_id, count(DISTINCT CASE WHEN NOT zone_reliable THEN document_id END) AS n_deduced FROM m_base GROUP BY item_id",
)
oracle(
    "compare_by_year",
    f"SELECT item_id, year::BIGINT AS year, n, price_median, indexed_median, reliability FROM ({block('item_id, year', '(SELECT *, year(document_date) AS year FROM m_base)', 'year IN (1996, 1997, 1998)')})",
)
oracle(
    "compare_by_work_type",
    """SELECT *, CASE WHEN normal_median > 0 AND extra_median > 0 THEN floor((extra_median - normal_median) / normal_median * 1000.0 + 0.5) / 10.0 END AS extra_gap_percent
    FROM (SELECT item_id, coalesce(max(n) FILTER (NOT is_extra), 0) AS normal_n, coalesce(max(n) FILTER (is_extra), 0) AS extra_n,
      max(indexed_median) FILTER (NOT is_extra) AS normal_median, max(indexed_median) FILTER (is_extra) AS extra_median FROM s GROUP BY item_id)""",
    BY_TYPE,
)


def grid(kind: str, extra: str = "") -> str:
    return f"""SELECT i.item_id, code, label_print, normal_n, normal_n_documents, normal_price_median, normal_price_p25, normal_price_p75,
      normal_price_mean, normal_price_min, normal_price_max, normal_indexed_median, normal_reliability, normal_last_date, extra_n, extra_price_median, extra_indexed_median, extra_reliability,
      extra_last_date, CASE WHEN normal_indexed_median > 0 AND extra_n IS NOT NULL THEN floor((extra_{kind}_median / normal_{kind}_median - 1.0) * 1000.0 + 0.5) / 10.0 END AS extra_gap_percent,
      item_unit, category_id, category_code{extra}
    FROM m_items i LEFT JOIN m_cats c USING (category_id) LEFT JOIN (
      SELECT item_id, max(n) FILTER (NOT is_extra)::DOUBLE AS normal_n, max(n_documents) FILTER (NOT is_extra)::DOUBLE AS normal_n_documents,
        max(price_median) FILTER (NOT is_extra) AS normal_price_median, max(price_p25) FILTER (NOT is_extra) AS normal_price_p25,
        max(price_p75) FILTER (NOT is_extra) AS normal_price_p75, max(price_mean) FILTER (NOT is_extra) AS normal_price_mean,
        max(price_min) FILTER (NOT is_extra) AS normal_price_min, max(price_max) FILTER (NOT is_extra) AS normal_price_max,
        max(indexed_median) FILTER (NOT is_extra) AS normal_indexed_median, max(reliability) FILTER (NOT is_extra) AS normal_reliability,
        max(last_date) FILTER (NOT is_extra) AS normal_last_date, max(n) FILTER (is_extra)::DOUBLE AS extra_n,
        max(price_median) FILTER (is_extra) AS extra_price_median, max(indexed_median) FILTER (is_extra) AS extra_indexed_median,
        max(reliability) FILTER (is_extra) AS extra_reliability, max(last_date) FILTER (is_extra) AS extra_last_date
      FROM s GROUP BY item_id) USING (item_id)
    WHERE active AND NOT is_lump"""


GRID_COLUMNS = (
    "item_id, code, label_print, normal_n, normal_n_documents, normal_price_median, normal_price_p25, normal_price_p75, normal_price_mean, "
    "normal_indexed_median, normal_reliability, normal_last_date, extra_n, extra_price_median, extra_indexed_median, extra_reliability, extra_last_date, extra_gap_percent"
)
oracle("price_grid", f"SELECT {GRID_COLUMNS} FROM ({grid('price')}) WHERE normal_n IS NOT NULL OR extra_n IS NOT NULL", BY_TYPE)
oracle(
    "price_grid_filtered",
    f"""SELECT {GRID_COLUMNS} FROM ({grid('indexed')}) WHERE normal_n IS NOT NULL AND greatest(coalesce(normal_n, 0), coalesce(extra_n, 0)) >= 4
    AND (normal_reliability IN ('moyenne', 'haute') OR extra_reliability IN ('moyenne', 'haute')) AND item_unit IN ('m2', 'ml', 'u')
    AND (category_id = 12 OR category_id IN (SELECT category_id FROM m_cats WHERE parent_id = 12))""",
    f"s AS ({block('item_id, is_extra', 'm_zbase', IN_PERIOD)})",
)
oracle(
    "price_grid_page",
    f"""SELECT {GRID_COLUMNS}, (SELECT count(*) FROM m_items WHERE active AND NOT is_lump) AS total_rows FROM ({grid('price')})
    ORDER BY coalesce(normal_price_median, extra_price_median) DESC NULLS LAST, item_id LIMIT 50 OFFSET 50""",
    BY_TYPE,
)
UNIT_CASE = "CASE item_unit " + " ".join(f"WHEN '{c}' THEN '{v}'" for c, v in UNIT_LABELS.items()) + " ELSE '' END"


def fr(x: str) -> str:
    return f"coalesce(replace(regexp_replace(({x})::VARCHAR, '\\.0$', ''), '.', ','), '')"


def quoted(x: str) -> str:
    return f"('\"' || replace(coalesce({x}, ''), '\"', '\"\"') || '\"')"


oracle(
    "csv_export_rows",
    "SELECT item_id, concat_ws(';', "
    + ", ".join(
        [quoted("category_code"), quoted("code"), quoted("label_print"), quoted(UNIT_CASE)]
        + [fr(f"normal_price_{p}") for p in ("median", "p25", "p75", "mean", "min", "max")]
        + [fr("normal_n"), fr("normal_n_documents"), fr("extra_price_median"), fr("extra_n"), fr("extra_gap_percent")]
        + [quoted("coalesce(normal_reliability, extra_reliability)"), quoted("coalesce(normal_last_date, extra_last_date)")]
    )
    + f") AS csv_line FROM ({grid('price')}) WHERE normal_n IS NOT NULL OR extra_n IS NOT NULL",
    BY_TYPE,
)

# ---- fees, quantities, co-occurrence ------------------------------------------------------------

FEES = f"""f AS (SELECT item_id, is_extra, count(*) AS n, {half('sum(total)::DOUBLE / count(total)', 2)} AS amount_mean,
    floor(quantile_cont((total * 100)::BIGINT, 0.5) / 1.0 + 0.5) / 100.0 AS amount_median, {half('avg(total::DOUBLE / document_total::DOUBLE) * 100.0', 2)} AS share_mean,
    {half('quantile_cont(total::DOUBLE / document_total::DOUBLE, 0.5) * 100.0', 2)} AS share_median,
    min(document_total)::DOUBLE AS document_min, max(document_total)::DOUBLE AS document_max
  FROM m_linked l JOIN m_docs d USING (document_id) JOIN m_items i USING (item_id)
  WHERE d.status <> 'rejete' AND control <> 'ecart' AND validated AND NOT excluded AND i.is_lump AND document_total > 0 GROUP BY item_id, is_extra)"""
oracle("site_fees", "SELECT * FROM f", FEES)
oracle(
    "fee_listing",
    """SELECT item_id, code, label_print, max(n) FILTER (NOT is_extra)::DOUBLE AS normal_n, max(amount_median) FILTER (NOT is_extra) AS normal_amount_median,
    max(share_median) FILTER (NOT is_extra) AS normal_share_median, max(n) FILTER (is_extra)::DOUBLE AS extra_n, max(amount_median) FILTER (is_extra) AS extra_amount_median,
    max(share_median) FILTER (is_extra) AS extra_share_median, max(share_median) AS top_share
    FROM m_items LEFT JOIN f USING (item_id) WHERE active AND is_lump GROUP BY item_id, code, label_print""",
    FEES,
)
oracle(
    "point_series",
    """SELECT item_id, line_id, document_id, document_date::VARCHAR AS date, quantity::DOUBLE AS quantity, unit_price::DOUBLE AS price,
    price_indexed::DOUBLE AS price_indexed, is_extra, zone_code FROM m_zbase""",
)
oracle(
    "quantity_threshold",
    """SELECT item_id, t::DOUBLE AS threshold, floor(below / 100.0 + 0.5) / 100.0 AS median_below, floor(above / 100.0 + 0.5) / 100.0 AS median_above, n_below, n_above
    FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY below - above DESC, t) AS r FROM e
      WHERE n_below >= 4 AND n_above >= 4 AND above < below * 0.95::DOUBLE) WHERE r = 1""",
    """c AS (SELECT DISTINCT item_id, quantity AS t FROM m_base),
    e AS (SELECT c.item_id, t, count(*) FILTER (quantity < t) AS n_below, count(*) FILTER (quantity >= t) AS n_above,
      quantile_cont((unit_price * 10000)::BIGINT, 0.5) FILTER (quantity < t) AS below, quantile_cont((unit_price * 10000)::BIGINT, 0.5) FILTER (quantity >= t) AS above
      FROM c JOIN m_base b USING (item_id) GROUP BY c.item_id, t)""",
)


def trend(x: str, y: str, where: str) -> str:
    return f"""SELECT item_id, n, x_first, {half('b + a * x_first', 2)} AS y_first, x_last, {half('b + a * x_last', 2)} AS y_last
    FROM (SELECT item_id, count(*) AS n, regr_slope(y, x) AS a, regr_intercept(y, x) AS b, min(x) AS x_first, max(x) AS x_last
      FROM (SELECT item_id, ({x})::DOUBLE AS x, ({y})::DOUBLE AS y FROM m_base WHERE {where}) GROUP BY item_id) WHERE n >= 3 AND x_first < x_last"""


oracle("trend_lines_by_date", trend("document_date - DATE '1970-01-01'", "unit_price", "document_date IS NOT NULL"))
oracle("trend_lines_by_quantity", trend("quantity", "price_indexed", "quantity > 0"))
COOC = f"""p AS (SELECT a.item_id AS item_a, b.item_id AS item_b, a.document_id, a.quantity::DOUBLE AS qa, b.quantity::DOUBLE AS qb
    FROM m_base a JOIN m_base b ON a.document_id = b.document_id AND a.item_id < b.item_id),
  t AS (SELECT item_id, count(DISTINCT document_id) AS nd FROM m_base GROUP BY item_id),
  cooc AS (SELECT item_a, item_b, count(DISTINCT document_id) AS n_together, ta.nd AS n_a, tb.nd AS n_b,
    {half('count(DISTINCT document_id) / ta.nd::DOUBLE', 3)} AS rate_given_a, {half('count(DISTINCT document_id) / tb.nd::DOUBLE', 3)} AS rate_given_b,
    {half('quantile_cont(qb / qa, 0.5)', 3)} AS ratio_b_over_a
    FROM p JOIN t ta ON ta.item_id = item_a JOIN t tb ON tb.item_id = item_b GROUP BY item_a, item_b, ta.nd, tb.nd HAVING count(DISTINCT document_id) >= 2)"""
oracle("cooccurrence", "SELECT * FROM cooc", COOC)
oracle(
    "cooccurrence_topk",
    f"""SELECT item_id, rank, partner_id, partner_label, rate, n_together, ratio FROM (
      SELECT s.*, label_print AS partner_label, row_number() OVER (PARTITION BY s.item_id ORDER BY rate DESC, n_together DESC, partner_id) AS rank
      FROM (SELECT item_a AS item_id, item_b AS partner_id, rate_given_a AS rate, n_together, ratio_b_over_a AS ratio FROM cooc
        UNION ALL SELECT item_b, item_a, rate_given_b, n_together, CASE WHEN ratio_b_over_a <> 0 THEN {half('1.0::DOUBLE / ratio_b_over_a', 3)} END FROM cooc) s
      JOIN m_items i ON i.item_id = s.partner_id WHERE i.active) WHERE rank <= 5""",
    COOC,
)

# ---- categories ------------------------------------------------------------------------------------

CLOSURE = """closure(a, d, depth) AS (SELECT category_id, category_id, 0 FROM m_cats
    UNION ALL SELECT c.a, t.category_id, c.depth + 1 FROM closure c JOIN m_cats t ON t.parent_id = c.d)"""
oracle("category_closure", "SELECT a::BIGINT AS ancestor_id, d::BIGINT AS descendant_id, depth::BIGINT AS depth FROM closure", CLOSURE, True)
oracle(
    "category_rollup",
    """SELECT c.category_id::BIGINT AS category_id, category_code, (parent_id IS NULL OR parent_id NOT IN (SELECT category_id FROM m_cats)) AS is_root,
    coalesce(n, 0) AS items, coalesce(p, 0) AS priced_items, coalesce(n_all, 0)::BIGINT AS items_all, coalesce(p_all, 0)::BIGINT AS priced_items_all
    FROM m_cats c LEFT JOIN own USING (category_id)
    LEFT JOIN (SELECT a, sum(n) AS n_all, sum(p) AS p_all FROM closure JOIN own ON d = category_id GROUP BY a) ON a = c.category_id""",
    CLOSURE
    + """, own AS (SELECT category_id, count(*) AS n, count(*) FILTER (item_id IN (SELECT item_id FROM m_base)) AS p FROM m_items WHERE active GROUP BY category_id)""",
    True,
)
oracle(
    "tree_checks",
    """SELECT c.category_id::BIGINT AS category_id, coalesce(n, 0) AS n_items, coalesce(k, 0) AS n_children, coalesce(n, 0) = 0 AND coalesce(k, 0) = 0 AS deletable,
    (coalesce(last, 0) + 1)::BIGINT AS next_child_order FROM m_cats c
    LEFT JOIN (SELECT category_id, count(*) AS n FROM m_items GROUP BY category_id) USING (category_id)
    LEFT JOIN (SELECT parent_id AS category_id, count(*) AS k, max(category_ord) AS last FROM m_cats WHERE parent_id IS NOT NULL GROUP BY parent_id) USING (category_id)""",
)
oracle(
    "move_checks",
    """SELECT m.category_id::BIGINT AS category_id, new_parent_id::BIGINT AS new_parent_id,
      NOT EXISTS (SELECT 1 FROM closure WHERE a = m.category_id AND d = new_parent_id) AS allowed
    FROM (SELECT parent_id AS category_id, category_id AS new_parent_id FROM m_cats UNION SELECT category_id, parent_id FROM m_cats WHERE parent_id IS NOT NULL) m WHERE m.category_id IS NOT NULL""",
    CLOSURE,
    True,
)
oracle(
    "category_sample",
    """SELECT category_id::BIGINT AS category_id, item_id, position FROM (SELECT *, row_number() OVER (PARTITION BY category_id ORDER BY md5('20260410:' || item_id), item_id) AS position
    FROM m_items WHERE active) WHERE position <= 5""",
)
CATPROP = """raw AS (SELECT CASE s_suppkey % 4 WHEN 0 THEN ' b' || s_suppkey WHEN 1 THEN 'x.' || s_suppkey WHEN 2 THEN 'bad code ' || s_suppkey ELSE 'N' || s_suppkey END AS code,
    s_name AS label, CASE s_nationkey % 3 WHEN 1 THEN 'g1' WHEN 2 THEN 'N' || s_nationkey END AS parent, s_suppkey AS ord FROM supplier),
  cp AS (SELECT upper(trim(code)) AS code, label, upper(parent) AS parent_code, ord FROM raw
    WHERE regexp_full_match(upper(trim(code)), '[A-Z0-9.]{2,20}') AND upper(trim(code)) NOT IN (SELECT category_code FROM m_cats)
    AND (parent IS NULL OR upper(parent) IN (SELECT category_code FROM m_cats) OR upper(parent) IN (SELECT upper(code) FROM raw)))"""
oracle("category_proposals", "SELECT * FROM cp", CATPROP)
oracle(
    "category_proposal_listing",
    """SELECT code, label, parent_code, (SELECT count(*) FROM part WHERE 'N' || (p_size % 30) = cp.code) AS n_items,
    parent_code IS NULL OR parent_code IN (SELECT category_code FROM m_cats) AS acceptable FROM cp""",
    CATPROP,
)
DECIDED = (
    CATPROP
    + """, want AS (SELECT *, ord % 3 <> 0 AND ord % 7 <> 0 AS sel FROM cp),
  acc AS (SELECT code FROM want WHERE sel AND (parent_code IS NULL OR parent_code IN (SELECT category_code FROM m_cats))
    UNION SELECT w.code FROM want w JOIN acc ON w.parent_code = acc.code WHERE w.sel),
  made AS (SELECT code, label, parent_code, (SELECT max(category_id) FROM m_cats) + row_number() OVER (ORDER BY code) AS category_id FROM acc JOIN want USING (code)),
  cats AS (SELECT category_id, category_code, category_label, parent_id FROM m_cats UNION ALL
    SELECT n.category_id, n.code, n.label, coalesce(c.category_id, p.category_id) FROM made n LEFT JOIN m_cats c ON c.category_code = n.parent_code LEFT JOIN made p ON p.code = n.parent_code)"""
)
oracle(
    "decided_category_proposals",
    """SELECT w.code, CASE WHEN made.code IS NOT NULL THEN 'accepte' WHEN ord % 7 = 0 THEN 'refuse' ELSE 'propose' END AS status, made.category_id::DOUBLE AS category_id,
    sel AND made.code IS NULL AS blocked FROM want w LEFT JOIN made USING (code)""",
    DECIDED,
    True,
)
oracle("accepted_categories", "SELECT category_id::BIGINT AS category_id, category_code, category_label, parent_id::DOUBLE AS parent_id FROM cats", DECIDED, True)
oracle(
    "applied_assignments",
    """SELECT item_id, coalesce(made.category_id, i.category_id)::BIGINT AS category_id,
    CASE WHEN made.code IS NOT NULL THEN 'accepte' WHEN w.code IS NOT NULL AND ord % 7 = 0 THEN 'refuse' ELSE 'propose' END AS status
    FROM m_items i JOIN part ON p_partkey = item_id LEFT JOIN want w ON w.code = 'N' || (p_size % 30) LEFT JOIN made ON made.code = w.code""",
    DECIDED,
    True,
)
oracle(
    "assigned_items",
    "SELECT item_id, coalesce(c.category_id, i.category_id)::BIGINT AS category_id FROM m_items i JOIN part ON p_partkey = item_id LEFT JOIN m_cats c ON category_code = 'B' || (p_size % 30)",
)
oracle(
    "items_of_categories",
    "SELECT category_id::BIGINT AS category_id, item_id, label_print, (SELECT count(*) FROM m_linked l WHERE l.item_id = i.item_id) AS n_links FROM m_items i WHERE active",
)

# ---- controls and normalisation -----------------------------------------------------------------------

PRINTED = f"""pl AS (SELECT *, quantity::DOUBLE * unit_price::DOUBLE AS expected, CASE WHEN k % 53 <> 7 THEN
      (floor(total::DOUBLE * (1.0::DOUBLE - (1.0::DOUBLE - confidence) / 20.0::DOUBLE) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE)::DECIMAL(14,2) END AS printed FROM m_lines),
  lc AS (SELECT *, CASE WHEN is_title OR printed IS NULL THEN 'non_verifiable'
      WHEN abs(expected - printed::DOUBLE) <= greatest(0.02::DOUBLE, abs(printed::DOUBLE) * 0.005::DOUBLE) THEN 'ok' ELSE 'ecart' END AS verdict FROM pl)"""
oracle(
    "line_controls",
    f"SELECT line_id, verdict AS control, CASE verdict WHEN 'ok' THEN 0.0::DOUBLE WHEN 'ecart' THEN {half('printed::DOUBLE - expected', 2)} END AS gap FROM lc",
    PRINTED,
)
oracle(
    "document_controls",
    f"""SELECT document_id, ct AS control_total, {half('s - t', 2)} AS gap_total,
      CASE WHEN abs(t * (1.0::DOUBLE + 20.0::DOUBLE / 100.0::DOUBLE) - g) <= greatest(0.02::DOUBLE, abs(g) * 0.005::DOUBLE) THEN 'ok' ELSE 'ecart' END AS control_vat,
      errors AS lines_in_error, n AS n_lines, {half('conf', 4)} AS mean_confidence,
      CASE WHEN ct = 'ok' AND errors = 0 AND type <> 'indetermine' THEN 'valide' ELSE 'a_revoir' END AS review_status
    FROM (SELECT *, CASE WHEN abs(s - t) <= greatest(0.02::DOUBLE, abs(t) * 0.005::DOUBLE) THEN 'ok' ELSE 'ecart' END AS ct FROM (
      SELECT document_id, type, coalesce(sum(printed) FILTER (NOT is_title)::DOUBLE, 0.0::DOUBLE) AS s, sum(total)::DOUBLE AS t,
        (CASE WHEN any_value(is_extra) THEN sum(total) * 1.2 ELSE sum(total) * 1.1 END)::DOUBLE AS g,
        count(*) FILTER (verdict = 'ecart') AS errors, count(*) AS n, avg(confidence) AS conf
      FROM lc JOIN m_docs USING (document_id) GROUP BY document_id, type))""",
    PRINTED,
)
oracle(
    "unit_normalization",
    """SELECT line_id, CASE WHEN u = 'ens' AND quantity > 1 THEN 'u' ELSE u END AS unit, f AS factor, floor(quantity::DOUBLE * f * 1000.0 + 0.5) / 1000.0 AS quantity_norm, f <> 1 AS price_unconverted
    FROM (SELECT line_id, quantity, coalesce((SELECT code FROM al WHERE alias = r), (SELECT min_by(code, alias) FROM al WHERE lower(alias) = lower(r))) AS u,
      coalesce((SELECT factor FROM al WHERE alias = r), (SELECT min_by(factor, alias) FROM al WHERE lower(alias) = lower(r)), 1)::DOUBLE AS f
      FROM (SELECT line_id, quantity, trim((['M2 ', 'm²', 'cm2', 'T', 'Ens', 'ENSEMBLE', 'xyz', NULL, 'U', 'Mètre Carré', 'fft', 'Kg'])[(k % 12) + 1]) AS r FROM m_lines))""",
    f"al(alias, code, factor) AS (VALUES {_values(UNIT_ALIASES)})",
)


def zone_of(cp: str) -> str:
    return f"coalesce((SELECT min(zone) FROM towns WHERE postal_code = {cp}), CASE substr({cp}, 1, 2) WHEN '06' THEN '06' WHEN '83' THEN '83_AUTRE' END)"


oracle(
    "zone_resolution",
    f"""SELECT document_id, coalesce({zone_of('site')}, {zone_of('client')}) AS zone_code, {zone_of('site')} IS NOT NULL AS zone_reliable
    FROM (SELECT o_orderkey AS document_id, trim((['06000', '83600 ', '06450', '06999', '83999', '75001', NULL, '83100'])[(o_orderkey % 8) + 1]) AS site,
      (['83000', '06420', '13001', NULL, '06410'])[(o_custkey % 5) + 1] AS client FROM orders)""",
    f"towns(postal_code, town, zone) AS (VALUES {_values(ZONE_TOWNS)})",
)


def made(y: str, mo: str, d: str) -> str:
    return f"(CASE WHEN {y} BETWEEN 2010 AND 2027 THEN try_cast({y} || '-' || lpad({mo}::VARCHAR, 2, '0') || '-' || lpad({d}::VARCHAR, 2, '0') AS DATE) END)"


oracle(
    "date_recovery",
    f"""SELECT document_id, coalesce(x, f)::VARCHAR AS document_date, CASE WHEN x IS NOT NULL THEN CASE WHEN s = 6 THEN 'document' ELSE 'raw' END WHEN f IS NOT NULL THEN 'fichier' END AS date_source
    FROM (SELECT document_id, s, CASE WHEN s IN (0, 1, 2, 5, 6) THEN {made('y', 'm', 'd')} WHEN s IN (3, 4) THEN {made('y', 'm', '1')} END AS x,
      CASE WHEN w = 3 THEN NULL ELSE {made('y', 'm', 'd')} END AS f
      FROM (SELECT o_orderkey AS document_id, o_orderkey % 10 AS s, o_orderkey % 4 AS w, year(dt) AS y, month(dt) AS m, day(dt) AS d
        FROM (SELECT o_orderkey, (o_orderdate::DATE + INTERVAL 300 MONTH)::DATE AS dt FROM orders)))""",
)
oracle("administrative_lines", f"SELECT line_id, search_text FROM m_worded WHERE regexp_matches(search_text, '{ADMIN}')")
CONTESTED = f"(off_scope AND off_scope_reason = 'llm' AND unit_price > 0 AND quantity > 0 AND NOT regexp_matches(search_text, '{ADMIN}'))"
oracle(
    "repaired_lines",
    f"""SELECT line_id, CASE WHEN unit = 'ens' AND quantity > 1 THEN 'u' ELSE unit END AS unit, off_scope AND NOT {CONTESTED} AS off_scope,
    CASE WHEN {CONTESTED} THEN 'llm-conteste' ELSE off_scope_reason END AS off_scope_reason FROM m_worded""",
)
oracle(
    "backfilled_units",
    """SELECT line_id, CASE WHEN r = 'U' THEN 'kg' ELSE code END AS unit, CASE WHEN r <> 'U' THEN floor(quantity::DOUBLE * factor::DOUBLE * 1000.0 + 0.5) / 1000.0 END AS quantity_norm
    FROM (SELECT line_id, quantity, trim((['M2 ', 'm²', 'cm2', 'T', 'Ens', 'ENSEMBLE', 'xyz', NULL, 'U', 'Mètre Carré', 'fft', 'Kg'])[(k % 12) + 1]) AS r FROM m_lines)
    LEFT JOIN (SELECT lower(alias) AS spelling, min_by(code, alias) AS code, min_by(factor, alias) AS factor FROM al GROUP BY 1) ON spelling = lower(r)""",
    f"al(alias, code, factor) AS (VALUES {_values(UNIT_ALIASES)})",
)
oracle(
    "answer_sources",
    """SELECT document_id AS answer_id, min(line_id) AS position, item_id, unit AS filters FROM m_linked GROUP BY document_id, item_id, unit""",
)
oracle(
    "off_scope_guard",
    f"SELECT line_id, NOT (unit_price > 0 AND quantity > 0 AND NOT regexp_matches(search_text, '{ADMIN}')) AS accepted FROM m_worded WHERE off_scope",
)


def posting_pairs(left: str, right: str, threshold: float, name: str = "pairs") -> str:
    """All pairs of distinct texts (tables with column x) by counting shared trigrams."""
    return f"""{name}_l AS (SELECT x, {tri('x')} AS g FROM (SELECT DISTINCT x FROM {left})), {name}_r AS (SELECT x, {tri('x')} AS g FROM (SELECT DISTINCT x FROM {right})),
  {name} AS (SELECT l.x AS lx, r.x AS rx, any_value(l.m) AS ka, any_value(r.m) AS kb, count(*) AS shared, count(*) / (any_value(l.m) + any_value(r.m) - count(*))::DOUBLE AS score
    FROM (SELECT x, len(g) AS m, unnest(g) AS t FROM {name}_l) l JOIN (SELECT x, len(g) AS m, unnest(g) AS t FROM {name}_r) r USING (t)
    GROUP BY l.x, r.x HAVING count(*) / (any_value(l.m) + any_value(r.m) - count(*))::DOUBLE >= {threshold})"""


RAWNAME = client_name("o_custkey")
oracle(
    "client_matching",
    f"""SELECT raw_name, coalesce(ac, sc)::DOUBLE AS client_id, CASE WHEN ac IS NOT NULL THEN 'alias' WHEN sc IS NOT NULL THEN 'trigramme' ELSE 'nouveau' END AS method,
      CASE WHEN ac IS NULL THEN {half('score', 6)} END AS score FROM (
      SELECT n.raw_name, (SELECT min(client_id) FROM kc WHERE upper(name) = n.raw_name) AS ac, b.sc, b.score
      FROM names n LEFT JOIN best b ON b.lx = {plain('n.raw_name')})""",
    f"""kc AS (SELECT * FROM m_clients WHERE client_id % 10 <> 3),
  names AS (SELECT DISTINCT trim(CASE WHEN o_custkey % 10 = 3 THEN 'Agence ' || {client_name('o_custkey + 1000003 * 17 + 5')} WHEN o_orderkey % 4 = 0 THEN {RAWNAME}
      WHEN o_orderkey % 4 = 1 THEN upper({RAWNAME}) WHEN o_orderkey % 4 = 2 THEN {RAWNAME} || 's' ELSE replace({RAWNAME}, 'e', 'é') END) AS raw_name FROM orders),
  lt AS (SELECT {plain('raw_name')} AS x FROM names), rt AS (SELECT {plain('name')} AS x, min(client_id) AS client_id FROM kc GROUP BY 1),
  {posting_pairs('lt', 'rt', 0.55)},
  best AS (SELECT lx, score, client_id AS sc FROM (SELECT *, row_number() OVER (PARTITION BY lx ORDER BY score DESC, client_id) AS r FROM pairs JOIN rt ON rt.x = rx) WHERE r = 1)""",
)

# ---- matching and duplicates ------------------------------------------------------------------------------

oracle(
    "rule_matching",
    f"""SELECT line_id, item_id, {half('score', 3)} AS score, 'regle' AS method, false AS validated, ok AS unit_ok FROM (
      SELECT o.line_id, i.item_id, p.score, {compatible('o.unit', 'i.item_unit')} AS ok,
        row_number() OVER (PARTITION BY o.line_id ORDER BY {compatible('o.unit', 'i.item_unit')} DESC, p.score DESC, i.item_id) AS r
      FROM o JOIN pairs p ON p.lx = o.search_text JOIN (SELECT min(item_id) AS item_id, item_unit, {plain('label_norm')} AS label FROM m_items WHERE active GROUP BY 2, 3) i ON i.label = p.rx) WHERE r = 1""",
    f"""o AS (SELECT line_id, unit, search_text, search_text AS x FROM m_worded WHERE NOT linked AND NOT is_title AND NOT off_scope),
  rt AS (SELECT {plain('label_norm')} AS x FROM m_items WHERE active), {posting_pairs('o', 'rt', 0.45)}""",
)
ANSWERS = """ga AS (SELECT line_id AS group_id, CASE WHEN k % 3 = 0 THEN 'P-' || (source_item_id - 1) END AS existing_code, 'ART-N-' || source_item_id AS base_code,
    CASE WHEN k % 5 <> 0 THEN 'article ' || source_item_id END AS label_norm, CASE WHEN k % 5 <> 0 THEN 'Article ' || source_item_id END AS label_print,
    'B' || (source_item_id % 30) AS category_code, CASE WHEN k % 3 = 0 THEN 'm2' END AS unit FROM m_lines WHERE NOT linked),
  fresh AS (SELECT *, row_number() OVER (PARTITION BY base_code ORDER BY group_id) AS r FROM ga
    WHERE (existing_code IS NULL OR existing_code NOT IN (SELECT code FROM m_items)) AND label_norm IS NOT NULL),
  ni AS (SELECT *, CASE WHEN r = 1 THEN base_code ELSE base_code || '-' || r END AS new_code FROM fresh)"""
oracle(
    "grouped_items",
    "SELECT group_id, new_code AS code, label_norm, label_print, category_id::DOUBLE AS category_id, unit AS item_unit, false AS is_lump FROM ni LEFT JOIN m_cats USING (category_code)",
    ANSWERS,
)
oracle(
    "grouped_links",
    """SELECT ga.group_id AS line_id, i.item_id::DOUBLE AS existing_item_id, new_code, 'llm' AS method, false AS validated
    FROM ga LEFT JOIN m_items i ON i.code = ga.existing_code LEFT JOIN ni USING (group_id) WHERE i.item_id IS NOT NULL OR new_code IS NOT NULL""",
    ANSWERS,
)
BLOCK = "is_lump::VARCHAR || '|' || coalesce(item_unit, '?')"
LABELS = f"""lab AS (SELECT {BLOCK} AS block, label_norm AS label, count(*) AS n_items FROM m_items WHERE active GROUP BY 1, 2),
  tok AS (SELECT block, label, len(g) AS kk, unnest(g) AS t FROM (SELECT block, label, {tri('label')} AS g FROM lab)),
  lp AS (SELECT a.block, a.label AS label_a, b.label AS label_b, count(*) / (any_value(a.kk) + any_value(b.kk) - count(*))::DOUBLE AS score
    FROM tok a JOIN tok b ON a.block = b.block AND a.t = b.t AND a.label < b.label GROUP BY 1, 2, 3
    HAVING count(*) / (any_value(a.kk) + any_value(b.kk) - count(*))::DOUBLE >= 0.6)"""
STANDING = f"""st AS (SELECT i.*, {BLOCK} AS block, coalesce(n, 0) AS n FROM m_items i LEFT JOIN (SELECT item_id, count(*) AS n FROM m_linked GROUP BY 1) USING (item_id) WHERE active),
  rep AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY block, label_norm ORDER BY n DESC, created_on DESC, item_id) AS r FROM st) WHERE r = 1),
  copies AS (SELECT s.item_id AS source_id, r.item_id AS target_id, s.category_id IS DISTINCT FROM r.category_id AS other_category
    FROM st s JOIN rep r ON s.block = r.block AND s.label_norm = r.label_norm WHERE s.item_id <> r.item_id)"""
oracle("trigram_pairs", f"SELECT block, label_a, label_b, {half('score', 6)} AS score FROM lp", LABELS)
oracle(
    "merge_proposals",
    f"""SELECT *, 'similarité ' || printf('%.2f', {half('score', 2)}) || CASE WHEN other_category THEN ' · lots différents' ELSE '' END AS reason FROM (
      SELECT CASE WHEN ka THEN b ELSE a END AS source_id, CASE WHEN ka THEN a ELSE b END AS target_id, {half('score', 3)} AS score, 'trigramme' AS method, other_category
      FROM (SELECT ra.item_id AS a, rb.item_id AS b, score, (ra.n, ra.created_on, -ra.item_id) >= (rb.n, rb.created_on, -rb.item_id) AS ka, ra.category_id IS DISTINCT FROM rb.category_id AS other_category
        FROM lp JOIN rep ra ON ra.block = lp.block AND ra.label_norm = label_a JOIN rep rb ON rb.block = lp.block AND rb.label_norm = label_b)
      UNION ALL SELECT source_id, target_id, 1.0::DOUBLE, 'trigramme', other_category FROM copies)""",
    f"{LABELS}, {STANDING}",
)
PROPOSALS = """pr AS (SELECT least(l_partkey, l_suppkey) AS source_id, greatest(l_partkey, l_suppkey) AS target_id, (round(max(l_tax) * 100)::INT / 10.0::DOUBLE)::DECIMAL(4,3) AS score,
    CASE WHEN min(l_linenumber) <= 2 THEN 'incertain' END AS verdict, min(l_quantity) AS quantity,
    CASE WHEN max(l_discount) >= 0.09::DOUBLE THEN 'refusee' WHEN max(l_discount) >= 0.08::DOUBLE THEN 'acceptee' ELSE 'proposee' END AS status
    FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY 1, 2)"""
VECTORS = f"""ev AS (SELECT st.*, list_transform(e.embedding::DOUBLE[], lambda x, k: x * CASE WHEN (item_id // 7 + k) % 5 = 0 THEN 1.6::DOUBLE ELSE 1.0::DOUBLE END) AS e
    FROM st JOIN embeddings e ON e.vec_id = (item_id * 7) % (SELECT max(vec_id) + 1 FROM embeddings)),
  en AS (SELECT *, row_number() OVER (PARTITION BY block, e ORDER BY n DESC, created_on DESC, item_id) AS r FROM ev),
  er AS (SELECT * FROM en WHERE r = 1),
  ep AS (SELECT CASE WHEN ka THEN b ELSE a END AS source_id, CASE WHEN ka THEN a ELSE b END AS target_id, {half('score', 3)} AS score, 'embedding' AS method, other_category
    FROM (SELECT a.item_id AS a, b.item_id AS b, list_cosine_similarity(a.e, b.e) AS score, (a.n, a.created_on, -a.item_id) >= (b.n, b.created_on, -b.item_id) AS ka,
        a.category_id IS DISTINCT FROM b.category_id AS other_category
      FROM er a JOIN er b ON a.block = b.block AND a.item_id < b.item_id WHERE list_cosine_similarity(a.e, b.e) >= 0.92)
    UNION ALL SELECT c.item_id, r.item_id, 1.0::DOUBLE, 'embedding', c.category_id IS DISTINCT FROM r.category_id
    FROM en c JOIN er r ON r.block = c.block AND r.e = c.e WHERE c.r > 1)"""
BOTH = """tp AS (SELECT CASE WHEN ka THEN b ELSE a END AS source_id, CASE WHEN ka THEN a ELSE b END AS target_id, score, 'trigramme' AS method FROM (
      SELECT ra.item_id AS a, rb.item_id AS b, score, (ra.n, ra.created_on, -ra.item_id) >= (rb.n, rb.created_on, -rb.item_id) AS ka
      FROM lp JOIN rep ra ON ra.block = lp.block AND ra.label_norm = label_a JOIN rep rb ON rb.block = lp.block AND rb.label_norm = label_b)
    UNION ALL SELECT source_id, target_id, 1.0::DOUBLE, 'trigramme' FROM copies),
  tn AS (SELECT * FROM tp WHERE (least(source_id, target_id), greatest(source_id, target_id)) NOT IN (SELECT (source_id, target_id) FROM pr)),
  found AS (SELECT source_id, target_id, score, method FROM tn UNION ALL SELECT source_id, target_id, score, method FROM ep
    WHERE (least(source_id, target_id), greatest(source_id, target_id)) NOT IN (SELECT (source_id, target_id) FROM pr)
      AND (least(source_id, target_id), greatest(source_id, target_id)) NOT IN (SELECT (least(source_id, target_id), greatest(source_id, target_id)) FROM tn))"""
NEW = f"{LABELS}, {STANDING}, {PROPOSALS}, {VECTORS}, {BOTH}"
# each source follows its smallest target to the end
MERGED = (
    NEW
    + """, first AS (SELECT source_id, min(target_id) AS target_id FROM found GROUP BY 1),
  follow AS (SELECT source_id, target_id FROM first UNION ALL SELECT f.source_id, n.target_id FROM follow f JOIN first n ON n.source_id = f.target_id),
  fin AS (SELECT source_id, target_id FROM follow WHERE target_id NOT IN (SELECT source_id FROM first))"""
)
oracle("new_merge_proposals", f"SELECT source_id, target_id, {half('score', 3)} AS score, method FROM found", NEW)
oracle(
    "embedding_proposals",
    f"SELECT *, 'proximité de sens ' || printf('%.2f', {half('score', 2)}) || CASE WHEN other_category THEN ' · lots différents' ELSE '' END AS reason FROM ep",
    f"{STANDING}, {VECTORS}",
)
oracle(
    "embedding_pairs",
    f"""SELECT a.block::VARCHAR AS block, a.node AS node_a, b.node AS node_b, {half('list_cosine_similarity(a.e, b.e)', 4)} AS score
    FROM nodes a JOIN nodes b ON a.block = b.block AND a.node < b.node WHERE list_cosine_similarity(a.e, b.e) >= 0.3""",
    "nodes AS (SELECT label AS block, embedding::DOUBLE[] AS e, min(vec_id) AS node FROM embeddings GROUP BY label, embedding)",
)
oracle(
    "embedding_groups",
    "SELECT label::BIGINT AS block, vec_id AS item_id, min(vec_id) OVER (PARTITION BY label, embedding) AS node, count(*) OVER (PARTITION BY label, embedding) AS n_items FROM embeddings",
)
oracle(
    "stale_embeddings",
    "SELECT item_id, created_on::VARCHAR AS created_on FROM m_items WHERE active AND (item_unit IS NULL OR item_id NOT IN (SELECT vec_id FROM embeddings))",
)

# ---- search -----------------------------------------------------------------------------------------------


def terms(values: list[str]) -> str:
    return f"terms AS (SELECT term, {plain('term')} AS p, {tri(plain('term'))} AS tg FROM (VALUES {_values([(v,) for v in values])}) t(term))"


def scored_items(a: float, b: float, c: float) -> str:
    return f"""it AS (SELECT *, {seq('lp')} AS sp, {seq('label_norm')} AS sn FROM (SELECT *, {plain('label_print')} AS lp FROM m_items WHERE active)),
  tx AS (SELECT search_text, {seq('search_text')} AS ss FROM (SELECT DISTINCT search_text FROM m_worded WHERE linked)),
  tw AS (SELECT term, search_text FROM terms, tx WHERE contains(search_text, p) OR {wsim('tg', 'ss')} > {c}),
  hit AS (SELECT DISTINCT term, item_id FROM tw JOIN m_worded USING (search_text) WHERE linked),
  sc AS (SELECT *, contains(lower(code), lower(term)) AS ch, {wsim('tg', 'sp')} AS wp, {wsim('tg', 'sn')} AS wn FROM terms, it),
  found AS (SELECT term, sc.item_id, code, label_print, greatest(CASE WHEN ch THEN 1.0 ELSE 0.0 END, wp, wn, {jac('tg', 'list_distinct(sp)')}) AS score
    FROM sc WHERE ch OR contains(lp, p) OR contains({plain('label_norm')}, p) OR wp > {a} OR wn > {b} OR EXISTS (SELECT 1 FROM hit WHERE hit.term = sc.term AND hit.item_id = sc.item_id))"""


oracle(
    "item_search",
    f"""SELECT term, rank, item_id, code, label_print, score FROM (SELECT term, item_id, code, label_print, {half('score', 6)} AS score,
      row_number() OVER (PARTITION BY term ORDER BY {half('score', 6)} DESC, label_print, item_id) AS rank FROM found) WHERE rank <= 10""",
    terms(["smal ring brand 7", "blu widgte", "P-12", "gizmo economy", "passivation"]) + ", " + scored_items(0.3, 0.3, 0.4),
)
oracle("grid_search", "SELECT item_id FROM found", terms(["large gaer brand 7"]) + ", " + scored_items(0.35, 0.35, 0.4))
oracle(
    "client_search",
    f"""SELECT term, rank, client_id, name, n_documents, total_amount, score FROM (
      SELECT term, client_id, name, coalesce(nd, 0) AS n_documents, coalesce(amount, 0)::DOUBLE AS total_amount, {half('greatest(ws, wh)', 6)} AS score,
        row_number() OVER (PARTITION BY term ORDER BY {half('greatest(ws, wh)', 6)} DESC, coalesce(nd, 0) DESC, client_id) AS rank
      FROM sc LEFT JOIN (SELECT client_id, count(*) AS nd, sum(document_total)::DOUBLE AS amount FROM m_docs WHERE client_id IS NOT NULL GROUP BY 1) USING (client_id)
      WHERE contains(nm, p) OR ws > 0.3 OR wh > 0.2) WHERE rank <= 10""",
    terms(["residence ibatlmo", "Copropriété", "cabinet rrr", "sci bctilmo"])
    + f""", cl AS (SELECT *, {seq('nm')} AS s FROM (SELECT *, {plain('name')} AS nm FROM m_clients)),
  sc AS (SELECT *, {wsim('tg', 's')} AS ws, {jac('tg', 'list_distinct(s)')} AS wh FROM terms, cl)""",
)
ORACLES["indexed_item_search"], ORACLES["indexed_client_search"] = ORACLES["item_search"], ORACLES["client_search"]
oracle(
    "document_search",
    f"""SELECT document_id, number FROM m_docs, terms WHERE client_id IN (SELECT client_id FROM cl, terms WHERE contains(nm, p) OR {wsim('tg', 's')} > 0.3)
    OR contains(lower(site_title), p) OR contains(lower(number), lower(term))""",
    terms(["residence ibatlmo"]) + f", cl AS (SELECT *, {seq('nm')} AS s FROM (SELECT *, {plain('name')} AS nm FROM m_clients))",
)
oracle(
    "line_search",
    f"""SELECT line_id, document_id, designation FROM m_worded JOIN m_docs USING (document_id), terms WHERE NOT is_title AND (
      client_id IN (SELECT client_id FROM m_clients, terms WHERE contains({plain('name')}, p)) OR contains(search_text, p)
      OR search_text IN (SELECT search_text FROM tx, terms WHERE {wsim('tg', 'ss')} > 0.35) OR (linked AND item_id IN (SELECT item_id FROM m_items, terms WHERE contains({plain('label_print')}, p))))""",
    terms(["compris gizom"]) + f", tx AS (SELECT search_text, {seq('search_text')} AS ss FROM (SELECT DISTINCT search_text FROM m_worded))",
)

# ---- curation -----------------------------------------------------------------------------------------------

STATE = "link_id, item_id, score, method, validated, validated_by, validated_on::VARCHAR AS validated_on"
EV = "ev AS (SELECT event_id AS document_id, event_id, ts, user_id, event_type FROM events)"
HIT = "e.event_type IN ('purchase', 'view') AND (NOT validated OR (e.event_type = 'view' AND e.user_id <> item_id))"
oracle(
    "bulk_validate",
    f"""SELECT link_id, CASE WHEN h AND view THEN user_id ELSE item_id END AS item_id, CASE WHEN h AND view THEN 1.0::DOUBLE ELSE score END AS score,
      CASE WHEN h AND view THEN 'manuel' ELSE method END AS method, h OR validated AS validated, CASE WHEN h THEN 'u' || user_id ELSE validated_by END AS validated_by,
      (CASE WHEN h THEN ts::DATE ELSE validated_on END)::VARCHAR AS validated_on
    FROM (SELECT l.*, e.user_id, e.ts, coalesce({HIT}, false) AS h, coalesce(e.event_type = 'view', false) AS view FROM m_linked l LEFT JOIN ev e USING (document_id))""",
    EV,
)
oracle(
    "bulk_validate_journal",
    f"""SELECT 'g' || event_id AS batch_id, CASE WHEN event_type = 'view' THEN 'modifier' ELSE 'valider' END AS action, link_id, 'u' || user_id AS actor, item_id AS item_before, validated AS validated_before
    FROM m_linked JOIN ev e USING (document_id) WHERE {HIT}""",
    EV,
)
oracle(
    "unvalidate",
    """SELECT link_id, item_id, score, method, validated AND NOT h AS validated, CASE WHEN NOT h THEN validated_by END AS validated_by, (CASE WHEN NOT h THEN validated_on END)::VARCHAR AS validated_on
    FROM (SELECT l.*, validated AND coalesce(e.event_type IN ('purchase', 'view'), false) AS h FROM m_linked l LEFT JOIN ev e USING (document_id))""",
    EV,
)
oracle(
    "automatic_undo",
    """SELECT link_id, item_id, score, method, validated AND NOT h AS validated, CASE WHEN NOT h THEN validated_by END AS validated_by, (CASE WHEN NOT h THEN validated_on END)::VARCHAR AS validated_on
    FROM (SELECT *, coalesce(validated_by IN ('auto', 'auto-llm'), false) AS h FROM m_linked)""",
)
oracle(
    "validation_per_item",
    f"""SELECT item_id, count(*) FILTER (ok) AS n_validated, count(*) FILTER (NOT ok) AS n_unit_ignored FROM (
      SELECT item_id, {compatible('unit', 'item_unit')} AS ok FROM m_linked JOIN m_docs d USING (document_id) JOIN m_items USING (item_id)
      WHERE NOT validated AND d.status <> 'rejete' AND active AND document_id NOT IN (SELECT document_id FROM ev WHERE event_type IN ('purchase', 'view'))) GROUP BY item_id""",
    EV,
)
AUTO = f"""av AS (SELECT link_id, item_id, label_print, score FROM m_linked JOIN m_docs d USING (document_id) JOIN m_items USING (item_id)
    WHERE NOT validated AND method = 'regle' AND score >= 0.8::DOUBLE AND active AND d.status <> 'rejete' AND unit IS NOT NULL AND {compatible('unit', 'item_unit')})"""
oracle("auto_validation", "SELECT * FROM av", AUTO)
oracle("auto_validation_report", "SELECT item_id, label_print, count(*) AS n_candidates FROM av GROUP BY 1, 2", AUTO)
oracle(
    "attach_lines",
    """SELECT line_id AS link_id, CASE WHEN h THEN user_id ELSE item_id END AS item_id, CASE WHEN h THEN 1.0::DOUBLE ELSE score END AS score, CASE WHEN h THEN 'manuel' ELSE method END AS method,
      h OR validated AS validated, CASE WHEN h THEN 'u' || user_id ELSE validated_by END AS validated_by, (CASE WHEN h THEN ts::DATE ELSE validated_on END)::VARCHAR AS validated_on
    FROM (SELECT l.*, e.user_id, e.ts, e.user_id IS NOT NULL AS h FROM m_lines l LEFT JOIN (SELECT * FROM ev WHERE event_type = 'signup') e USING (document_id)) WHERE linked OR h""",
    EV,
)
oracle(
    "identical_orphans",
    """SELECT c.line_id AS chosen_id, count(*) AS n_identical FROM (SELECT * FROM m_worded WHERE NOT linked AND document_id IN (SELECT document_id FROM ev WHERE event_type = 'click')) c
    JOIN (SELECT search_text FROM m_worded WHERE NOT linked AND NOT is_title AND unit_price > 0) o USING (search_text) GROUP BY 1""",
    EV,
)
oracle(
    "attach_identical",
    """SELECT o.line_id, c.user_id AS target_item_id, 'g' || c.event_id AS batch_id, 'u' || c.user_id AS actor, c.ts::DATE::VARCHAR AS day
    FROM m_worded o JOIN cmd c USING (search_text)
    WHERE NOT o.linked AND NOT o.is_title AND o.unit_price > 0 AND o.document_id NOT IN (SELECT document_id FROM ev WHERE event_type = 'signup')
    QUALIFY row_number() OVER (PARTITION BY o.line_id ORDER BY c.ts DESC, 'g' || c.event_id DESC) = 1""",
    EV + ", cmd AS (SELECT DISTINCT search_text, event_id, user_id, ts FROM m_worded JOIN ev USING (document_id) WHERE event_type = 'signup')",
)
oracle("merged_links", "SELECT link_id, coalesce(target_id, item_id) AS item_id FROM m_linked LEFT JOIN fin ON source_id = item_id", MERGED, True)
oracle("merged_items", "SELECT item_id, active AND item_id NOT IN (SELECT source_id FROM fin) AS active FROM m_items", MERGED, True)
oracle(
    "merged_proposals",
    """SELECT CASE WHEN status = 'proposee' AND (source_id IN (SELECT source_id FROM fin) OR target_id IN (SELECT source_id FROM fin)) THEN 'obsolete' ELSE status END AS status, count(*) AS n
    FROM pr GROUP BY 1""",
    MERGED,
    True,
)
oracle(
    "proposal_verdicts",
    """SELECT source_id, target_id, CASE WHEN o THEN v ELSE verdict END AS verdict, CASE WHEN o AND quantity > 40 THEN 'section' END AS reason, CASE WHEN o AND v = 'distinct' THEN 'refusee' ELSE status END AS status
    FROM (SELECT *, CASE WHEN quantity > 25 THEN 'distinct' ELSE 'meme' END AS v, status = 'proposee' AND quantity > 5 AS o FROM pr)""",
    PROPOSALS,
)
oracle(
    "proposal_decisions",
    """SELECT CASE WHEN f THEN target_id ELSE source_id END AS source_id, CASE WHEN f THEN source_id ELSE target_id END AS target_id,
      CASE WHEN o AND quantity > 30 THEN 'acceptee' WHEN o THEN 'refusee' ELSE status END AS status
    FROM (SELECT *, status = 'proposee' AND quantity > 20 AS o, status = 'proposee' AND quantity > 45 AS f FROM pr)""",
    PROPOSALS,
)
oracle(
    "proposal_listing",
    """SELECT source_id, target_id, score::DOUBLE AS score, s.label_print AS source_label, t.label_print AS target_label FROM pr JOIN m_items s ON s.item_id = source_id JOIN m_items t ON t.item_id = target_id
    WHERE status = 'proposee' AND s.active AND t.active ORDER BY pr.score DESC NULLS LAST, s.label_print, source_id, target_id LIMIT 200""",
    PROPOSALS,
)
oracle(
    "proposal_evidence",
    """SELECT source_id, target_id, s.item_unit AS source_unit, t.item_unit AS target_unit, a.w AS source_wordings, b.w AS target_wordings
    FROM pr JOIN m_items s ON s.item_id = source_id JOIN m_items t ON t.item_id = target_id LEFT JOIN w a ON a.item_id = source_id LEFT JOIN w b ON b.item_id = target_id
    WHERE status = 'proposee' AND verdict IS NULL""",
    PROPOSALS
    + ", w AS (SELECT item_id, array_to_string(list_sort(list(DISTINCT designation))[1:3], ' / ') AS w FROM m_worded WHERE linked GROUP BY item_id)",
)
oracle(
    "proposal_status_report",
    "SELECT count(*) FILTER (status = 'proposee') AS n_open, count(*) FILTER (status = 'refusee') AS n_refused, count(*) FILTER (status = 'acceptee') AS n_accepted FROM pr",
    PROPOSALS,
)
oracle(
    "validation_status_report",
    "SELECT count(*) FILTER (validated) AS n_validated, count(*) FILTER (NOT validated) AS n_pending, (SELECT count(DISTINCT item_id) FROM m_base) AS n_priced_items FROM m_linked",
)
# what an undone gesture leaves behind: the links as they were
oracle("validate_then_undo", f"SELECT {STATE} FROM m_linked")
oracle("attach_then_undo", f"SELECT {STATE} FROM m_linked")
oracle("merge_then_undo", "SELECT link_id, item_id, active FROM m_linked JOIN m_items USING (item_id)")

JOURNAL = f"""{EV}, jo AS (SELECT event_id * 100 + ord AS seq, 'u' || user_id || '-' || ts::DATE::VARCHAR AS batch_id, link_id, item_id, event_type, ts FROM m_linked JOIN ev USING (document_id)),
  lg AS (SELECT batch_id, count(link_id) AS n, max(seq) AS last_seq, max(ts) AS latest_ts FROM jo WHERE event_type <> 'error' GROUP BY 1 ORDER BY latest_ts DESC, last_seq DESC LIMIT 200)"""
oracle("last_gestures", "SELECT batch_id, n, last_seq FROM lg", JOURNAL)
oracle(
    "undo_last",
    """SELECT link_id, CASE WHEN u IS NOT NULL THEN l.item_id + 1 ELSE l.item_id END AS item_id, CASE WHEN u IS NOT NULL THEN 0.5::DOUBLE ELSE score END AS score, CASE WHEN u IS NOT NULL THEN 'regle' ELSE method END AS method,
      u IS NULL AND validated AS validated, CASE WHEN u IS NULL THEN validated_by END AS validated_by, (CASE WHEN u IS NULL THEN validated_on END)::VARCHAR AS validated_on
    FROM m_linked l LEFT JOIN (SELECT link_id, event_type AS u FROM jo WHERE event_type <> 'error' AND batch_id IN (SELECT batch_id FROM lg)) USING (link_id) WHERE u IS NULL OR u <> 'signup'""",
    JOURNAL,
)
oracle(
    "exclusion_changes",
    """SELECT link_id, CASE event_type WHEN 'error' THEN true WHEN 'signup' THEN false ELSE excluded END AS excluded,
      CASE event_type WHEN 'error' THEN 'hors norme' WHEN 'signup' THEN NULL ELSE exclusion_reason END AS exclusion_reason FROM m_linked LEFT JOIN ev USING (document_id)""",
    EV,
)
oracle(
    "document_edits",
    """SELECT document_id, CASE WHEN event_type = 'error' THEN 'rejete' ELSE status END AS status, (CASE WHEN event_type = 'click' THEN user_id % 5 ELSE zone_id END)::DOUBLE AS zone_id,
      (CASE WHEN event_type = 'click' THEN true ELSE zone_reliable END)::VARCHAR AS zone_reliable, (CASE WHEN event_type = 'view' THEN ts::DATE ELSE document_date END)::VARCHAR AS document_date
    FROM m_docs LEFT JOIN ev USING (document_id)""",
    EV,
)
oracle(
    "scope_reviews",
    """SELECT line_id, off_scope AND NOT coalesce(event_type = 'view', false) AS off_scope,
      CASE WHEN off_scope AND event_type = 'purchase' THEN 'humain:u' || user_id WHEN off_scope AND event_type = 'view' THEN 'reintegre:u' || user_id ELSE off_scope_reason END AS off_scope_reason
    FROM m_lines LEFT JOIN ev USING (document_id)""",
    EV,
)
PENDING = f"""pe AS (SELECT w.*, w.line_id AS link_id, d.document_date, d.status, item_unit, label_print, label_norm, active, {compatible('unit', 'item_unit')} AS unit_ok
    FROM m_worded w JOIN m_docs d USING (document_id) JOIN m_items i USING (item_id) WHERE linked AND NOT validated AND d.status <> 'rejete')"""


def queue(where: str = "true") -> str:
    return f"""SELECT q.item_id, label_print, n_pending, n_impact, coalesce(n_validated, 0) AS n_validated, coalesce(n_auto, 0) AS n_auto, samples FROM (
      SELECT item_id, label_print, count(*) AS n_pending, count(*) FILTER (unit_price > 0 AND control <> 'ecart' AND unit NOT IN ('ens', 'forfait') AND unit_ok) AS n_impact,
        array_to_string(list_sort(list(DISTINCT designation))[1:3], ' / ') AS samples FROM pe WHERE active AND {where} GROUP BY 1, 2) q
    LEFT JOIN (SELECT item_id, count(*) AS n_validated, count(*) FILTER (validated_by IN ('auto', 'auto-llm')) AS n_auto FROM m_linked WHERE validated GROUP BY 1) USING (item_id)"""


oracle("item_queue", queue(), PENDING)
oracle(
    "item_queue_filtered",
    queue(f"method = 'regle' AND status = 'a_revoir' AND (contains(search_text, 'widget') OR contains({plain('label_print')}, 'widget') OR contains(label_norm, 'widget'))"),
    PENDING,
)
oracle(
    "item_queue_lines",
    """SELECT item_id, position, line_id, n > 3 AS truncated, unit_ok FROM (SELECT *, count(*) OVER (PARTITION BY item_id) AS n,
      row_number() OVER (PARTITION BY item_id ORDER BY document_date DESC NULLS LAST, ord, line_id) AS position FROM pe) WHERE position <= 3""",
    PENDING,
)
oracle(
    "review_queue",
    """SELECT line_id, item_id, same_item, score, unit_ok FROM (SELECT *, count(*) OVER (PARTITION BY item_id) - 1 AS same_item FROM pe)
    ORDER BY same_item DESC, item_id, score ASC NULLS FIRST, document_date ASC NULLS LAST, line_id LIMIT 20 OFFSET 40""",
    PENDING,
)
oracle(
    "pending_groups",
    """SELECT link_id, item_id, n_pending, designation, unit, unit_price::DOUBLE AS unit_price, unit_ok FROM (SELECT *, count(*) OVER (PARTITION BY item_id) AS n_pending FROM pe WHERE active) WHERE n_pending >= 2""",
    PENDING,
)
ALTERNATIVES = f"""pw AS (SELECT DISTINCT search_text, unit FROM pe),
  pt AS (SELECT search_text, len(g) AS n, unnest(g) AS t FROM (SELECT search_text, {tri('search_text')} AS g FROM (SELECT DISTINCT search_text FROM pw))),
  pl AS (SELECT label, len(g) AS n, unnest(g) AS t FROM (SELECT label, {tri('label')} AS g FROM (SELECT DISTINCT label_norm AS label FROM m_items WHERE active))),
  met AS (SELECT search_text, label, count(*) / (any_value(pt.n) + any_value(pl.n) - count(*))::DOUBLE AS score FROM pt JOIN pl USING (t) GROUP BY 1, 2),
  best AS (SELECT w.search_text, w.unit, i.item_id, coalesce(score, 0.0::DOUBLE) AS score, coalesce({compatible('w.unit', 'i.item_unit')}, false) AS ok,
      row_number() OVER (PARTITION BY w.search_text, w.unit ORDER BY coalesce({compatible('w.unit', 'i.item_unit')}, false) DESC, coalesce(score, 0.0::DOUBLE) DESC, i.item_id) AS r
    FROM pw w CROSS JOIN m_items i LEFT JOIN met ON met.search_text = w.search_text AND met.label = i.label_norm WHERE i.active QUALIFY r <= 4)"""


def alternatives(lines: str) -> str:
    return f"""SELECT line_id, row_number() OVER (PARTITION BY line_id ORDER BY r) AS rank, b.item_id, {half('b.score', 3)} AS score, b.ok
    FROM {lines} pe JOIN best b ON b.search_text = pe.search_text AND b.unit IS NOT DISTINCT FROM pe.unit WHERE b.item_id <> pe.item_id
    QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY r) <= 3"""


oracle("match_alternatives", alternatives("pe"), f"{PENDING}, {ALTERNATIVES}")
oracle(
    "review_queue_alternatives",
    alternatives(
        """(SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY item_id) - 1 AS same_item FROM pe)
      ORDER BY same_item DESC, item_id, score ASC NULLS FIRST, document_date ASC NULLS LAST, line_id LIMIT 20 OFFSET 40)"""
    ),
    f"{PENDING}, {ALTERNATIVES}",
)
ORPHANS = """orp AS (SELECT line_id, document_id, search_text, document_date, count(*) OVER (PARTITION BY search_text) AS n_identical FROM m_worded JOIN m_docs d USING (document_id)
    WHERE NOT linked AND NOT is_title AND NOT off_scope AND unit_price > 0 AND d.status <> 'rejete')"""
oracle("orphan_queue", "SELECT line_id, document_id, search_text, n_identical FROM orp", ORPHANS)
oracle(
    "orphan_queue_page",
    "SELECT line_id, search_text, n_identical, (SELECT count(*) FROM orp) AS total_rows FROM orp ORDER BY n_identical DESC, search_text, document_date DESC NULLS LAST, line_id LIMIT 50",
    ORPHANS,
)
oracle(
    "orphan_documents",
    "SELECT document_id, count(*) AS n_orphans FROM m_lines JOIN m_docs d USING (document_id) WHERE NOT linked AND NOT is_title AND NOT off_scope AND d.status <> 'rejete' GROUP BY 1",
)

# ---- history and reports ---------------------------------------------------------------------------------------

COUNTS = "lcnt AS (SELECT document_id, count(*) FILTER (NOT is_title) AS n_lines, count(*) FILTER (control = 'ecart') AS n_errors FROM m_lines GROUP BY 1)"
oracle(
    "documents_list",
    """SELECT document_id, number, document_date::VARCHAR AS document_date, type, name AS client, zone_code, document_total::DOUBLE AS document_total, coalesce(n_lines, 0) AS n_lines, status
    FROM m_docs d LEFT JOIN m_zones USING (zone_id) LEFT JOIN m_clients USING (client_id) LEFT JOIN lcnt USING (document_id)
    WHERE zone_code IN ('ASIA', 'AMERICA') AND type IN ('devis', 'facture') AND NOT is_extra AND document_date >= DATE '1995-06-01' AND document_total BETWEEN 50000 AND 400000
      AND document_id IN (SELECT document_id FROM m_linked JOIN m_items USING (item_id) WHERE category_id = 107)""",
    COUNTS,
)
oracle(
    "documents_page",
    """SELECT document_id, number, document_date::VARCHAR AS document_date, name AS client, coalesce(n_lines, 0) AS n_lines, (SELECT count(*) FROM m_docs) AS total_rows
    FROM m_docs d LEFT JOIN m_clients USING (client_id) LEFT JOIN lcnt USING (document_id) ORDER BY d.document_date DESC NULLS LAST, number DESC, document_id LIMIT 25 OFFSET 25""",
    COUNTS,
)
oracle(
    "document_lines",
    """SELECT line_id, document_id, ord::BIGINT AS ord, quantity::DOUBLE AS quantity, unit_price::DOUBLE AS unit_price, total::DOUBLE AS total, linked AND excluded AS excluded,
    CASE WHEN linked THEN exclusion_reason END AS exclusion_reason FROM m_lines WHERE NOT is_title""",
)
INDEXED = "floor(unit_price::DOUBLE * (latest / coalesce(coefficient::DOUBLE, 1.0)) * 10000.0 + 0.5) / 10000.0 AS price_indexed"
oracle(
    "history_lines",
    f"""SELECT line_id, document_id, designation, name AS client, zone_label, label_print AS item_label, category_label, (CASE WHEN linked THEN validated END)::VARCHAR AS validated, {INDEXED}
    FROM m_worded w JOIN m_docs d USING (document_id) LEFT JOIN m_items i ON linked AND i.item_id = w.item_id LEFT JOIN m_cats c ON c.category_id = i.category_id LEFT JOIN m_clients USING (client_id)
    LEFT JOIN m_zones z ON z.zone_id = d.zone_id LEFT JOIN m_index ON mon = date_trunc('month', document_date), m_latest WHERE NOT is_title AND is_extra AND document_date <= DATE '2000-12-31'""",
)
oracle(
    "item_lines",
    f"""SELECT line_id, item_id, document_id, name AS client, zone_code, excluded, unit_price::DOUBLE AS unit_price, {INDEXED}
    FROM m_linked JOIN m_docs d USING (document_id) LEFT JOIN m_zones USING (zone_id) LEFT JOIN m_clients USING (client_id) LEFT JOIN m_index ON mon = date_trunc('month', document_date), m_latest
    WHERE validated AND d.status <> 'rejete' AND control <> 'ecart' AND {IN_PERIOD}""",
)
oracle(
    "off_scope_lines",
    "SELECT line_id, document_id, search_text FROM m_worded JOIN m_docs d USING (document_id) WHERE off_scope AND off_scope_reason = 'llm' AND d.status <> 'rejete' AND contains(search_text, 'brand')",
)
oracle("incomplete_documents", "SELECT document_id, status FROM m_docs WHERE status <> 'rejete' AND (document_date IS NULL OR zone_id IS NULL OR client_id IS NULL)")
oracle(
    "review_documents",
    """SELECT document_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_errors, 0) AS n_errors, line_id, quantity::DOUBLE AS quantity, total::DOUBLE AS total
    FROM m_docs d LEFT JOIN lcnt USING (document_id) LEFT JOIN (SELECT * FROM m_lines WHERE NOT is_title AND control = 'ecart') l USING (document_id) WHERE d.status = 'a_revoir'""",
    COUNTS,
)
oracle("client_totals", "SELECT client_id, count(*) AS n_documents, sum(document_total)::DOUBLE AS total_amount FROM m_docs WHERE client_id IS NOT NULL GROUP BY 1")
oracle(
    "summary_kpis",
    """SELECT (SELECT count(*) FROM m_items WHERE active) AS n_items, (SELECT count(DISTINCT item_id) FROM m_base) AS n_priced_items, (SELECT count(*) FROM m_cats WHERE parent_id IS NULL) AS n_categories,
    (SELECT count(*) FROM m_zones) AS n_zones, (SELECT count(*) FROM m_docs WHERE status <> 'rejete') AS n_documents, (SELECT count(DISTINCT client_id) FROM m_docs) AS n_clients,
    (SELECT min(document_date)::VARCHAR FROM m_docs) AS first_date, (SELECT max(document_date)::VARCHAR FROM m_docs) AS last_date, (SELECT max(created_on)::VARCHAR FROM m_docs) AS last_write,
    (SELECT count(*) FROM m_lines JOIN m_docs d USING (document_id) WHERE NOT is_title AND d.status <> 'rejete') AS n_lines""",
)
oracle(
    "progress_kpis",
    """SELECT *, floor(n_validated / n_lines * 100.0 + 0.5)::DOUBLE AS percent_validated FROM (SELECT (SELECT count(*) FROM m_lines WHERE NOT is_title) AS n_lines, (SELECT count(*) FROM m_linked WHERE validated) AS n_validated,
    (SELECT count(*) FROM m_linked WHERE validated_by IN ('auto', 'auto-llm')) AS n_auto, (SELECT count(*) FROM m_docs WHERE status = 'a_revoir') AS n_to_review,
    (SELECT count(*) FROM m_items WHERE active AND item_id NOT IN (SELECT item_id FROM m_linked WHERE validated)) AS n_items_unvalidated,
    (SELECT count(*) FROM m_linked JOIN m_docs d USING (document_id) WHERE NOT validated AND d.status <> 'rejete') AS n_pending, (SELECT count(*) FROM orp) AS n_orphans,
    (SELECT count(*) FROM pr JOIN m_items s ON s.item_id = source_id JOIN m_items t ON t.item_id = target_id WHERE status = 'proposee' AND s.active AND t.active) AS n_duplicates,
    (SELECT count(*) FROM m_lines JOIN m_docs d USING (document_id) WHERE off_scope AND off_scope_reason = 'llm' AND d.status <> 'rejete') AS n_off_scope,
    (SELECT count(*) FROM cp) AS n_category_proposals, (SELECT count(*) FROM m_docs WHERE status <> 'rejete' AND (document_date IS NULL OR zone_id IS NULL OR client_id IS NULL)) AS n_incomplete)""",
    f"{ORPHANS}, {PROPOSALS}, {CATPROP}",
)

# ---- ingest ------------------------------------------------------------------------------------------------------

FILES = """fi AS (SELECT doc_id, lang, text, 'Pièce n° ' || doc_id || '.' || (['pdf', 'XLSX', 'ods', 'txt'])[(doc_id % 4) + 1] AS file_name, sha256(text) AS h FROM documents)"""
oracle(
    "file_inventory",
    """SELECT file_name, h AS file_hash, strlen(text)::BIGINT AS size, lower(string_split(file_name, '.')[-1]) AS extension, doc_id % 4 <> 3 AS accepted,
    CASE WHEN doc_id % 4 = 0 THEN len(regexp_extract_all(text, '/Type\\s*/Page[^s]'))::DOUBLE END AS pages, 'devis/' || substr(h, 1, 12) || '/Piece_n_' || doc_id || '.' || string_split(file_name, '.')[-1] AS storage_key FROM fi""",
    FILES,
)
oracle(
    "hash_dedup",
    """SELECT file_name, h AS file_hash, CASE WHEN k.d IS NOT NULL OR file_name <> min(file_name) OVER (PARTITION BY h) THEN 'doublon' ELSE 'en_attente' END AS status, k.d::DOUBLE AS document_id
    FROM fi LEFT JOIN (SELECT h, min(doc_id) AS d FROM fi WHERE lang = 'de' GROUP BY h) k USING (h)""",
    FILES,
)
PAYLOAD = """pa AS (SELECT l.*, d.type, d.number, d.site_title, d.is_extra, CASE k % 23 WHEN 0 THEN 'json' WHEN 1 THEN 'type_document' WHEN 2 THEN 'ligne' END AS error, ord || '-' || line_id AS segment
    FROM m_lines l JOIN m_docs d USING (document_id))"""
oracle(
    "payload_lines",
    """SELECT line_id, document_id AS document_key, ord::BIGINT AS ordre, 'Article ' || source_item_id AS designation, unit AS unite_brute, quantity::DOUBLE AS quantite, unit_price::DOUBLE AS pu_ht, total::DOUBLE AS total_ht,
    is_title AS est_titre, CASE WHEN k % 3 <> 0 THEN ord::DOUBLE END AS attr_section_mm, ord * 0.5::DOUBLE AS attr_longueur_m, 'acier' AS attr_materiau, (k % 2 = 0)::VARCHAR AS attr_fourniture_incluse, confidence AS confiance
    FROM pa WHERE error IS NULL""",
    PAYLOAD,
)
oracle("payload_quarantine", "SELECT line_id, error FROM pa WHERE error IS NOT NULL", PAYLOAD)
oracle(
    "segment_merge_headers",
    """SELECT document_id AS document_key, coalesce(min_by(type, segment) FILTER (k % 5 <> 0 AND type <> 'indetermine'), 'indetermine') AS type_document, min_by(number, segment) FILTER (k % 4 = 0) AS numero_document,
    min_by(site_title, segment) FILTER (k % 6 = 0) AS chantier_objet, max(total)::DOUBLE AS total_ht, string_agg('ligne ' || ord, ' | ' ORDER BY segment) FILTER (k % 7 = 0) AS remarques, any_value(is_extra)::VARCHAR AS est_ts
    FROM pa WHERE error IS NULL GROUP BY document_id""",
    PAYLOAD,
)
oracle("segment_merge_lines", "SELECT line_id, document_id AS document_key, row_number() OVER (PARTITION BY document_id ORDER BY segment) AS ord FROM pa WHERE error IS NULL", PAYLOAD)
LEDGER = """ls AS (SELECT *, event_type AS st FROM events),
  le AS (SELECT user_id AS file, CASE max_by(event_type, (ts, event_id)) WHEN 'click' THEN 'en_attente' WHEN 'view' THEN 'extraction' WHEN 'signup' THEN 'extrait' WHEN 'purchase' THEN 'insere' ELSE 'erreur' END AS status,
    min(ts) AS created_at, max(ts) AS updated_at, count(*) AS n_events FROM events GROUP BY user_id)"""
oracle("ledger_state", "SELECT file, status, regexp_replace(created_at::VARCHAR, '0+$', '') AS created_at, regexp_replace(updated_at::VARCHAR, '0+$', '') AS updated_at, n_events FROM le", LEDGER)
STUCK = "(status = 'erreur' OR (status IN ('en_attente', 'extraction', 'extrait') AND updated_at < TIMESTAMP '2024-01-30 11:30:00'))"
oracle(
    "import_stats",
    f"SELECT count(*) FILTER (status = 'insere') AS n_inserted, count(*) FILTER ({STUCK}) AS n_failed, count(*) FILTER (status = 'doublon') AS n_duplicates, count(*) AS n_imports FROM le",
    LEDGER,
)
oracle(
    "retry_set",
    f"SELECT file, status, md5(file::VARCHAR) AS file_hash FROM le WHERE {STUCK} AND n_events % 4 <> 0 AND file NOT IN (SELECT user_id FROM events WHERE event_id % 7 = 0)",
    LEDGER,
)
oracle(
    "batch_results",
    """SELECT user_id::VARCHAR AS import_id, CASE WHEN event_type <> 'error' THEN 'e' || event_id END AS content, CASE WHEN event_type = 'error' THEN 'Réponse vide (statut HTTP 500).' END AS error, 'f' || user_id AS file_name
    FROM events JOIN le ON file = user_id WHERE status <> 'insere'""",
    LEDGER,
)
oracle(
    "event_counts",
    """SELECT date_trunc('hour', ts)::TIMESTAMP::VARCHAR AS window_start, CASE event_type WHEN 'click' THEN 'en_attente' WHEN 'view' THEN 'extraction' WHEN 'signup' THEN 'extrait' WHEN 'purchase' THEN 'insere' ELSE 'erreur' END AS state,
    count(*) AS n FROM events GROUP BY 1, 2""",
)

# ---- grid search and the questions of an assistant: the same definitions, one object at a time -----------------------


def only(name: str, columns: str, where: str) -> str:
    return f"SELECT {columns} FROM ({ORACLES[name]}) AS x WHERE {where}"


ORACLES["price_grid_search"] = only("price_grid", "*", f"item_id IN ({ORACLES['grid_search']})")
ORACLES["tool_site_fees"] = f"""SELECT item_id, label_print, is_extra::VARCHAR AS is_extra, n, amount_median, share_median FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY is_extra) AS nth FROM ({ORACLES['site_fees']})) AS x
    JOIN (SELECT item_id, label_print FROM ({with_prelude('SELECT * FROM m_items WHERE active')})) AS i USING (item_id)
    WHERE nth = 1 AND contains(lower(label_print), 'large')"""
ORACLES["tool_find_items"] = f"""SELECT rank, item_id, score, category_code, coalesce(n, 0) AS n, price_median
    FROM ({ORACLES['item_search']}) AS x
    JOIN ({with_prelude('SELECT item_id, category_code FROM m_items LEFT JOIN m_cats USING (category_id)')}) AS i USING (item_id)
    LEFT JOIN (SELECT item_id, n, price_median FROM ({ORACLES['price_stats_levels']}) AS l WHERE level = 'global') AS p USING (item_id)
    WHERE term = 'smal ring brand 7'"""
ORACLES["tool_find_client"] = only("client_search", "*", "term = 'residence ibatlmo'")
ORACLES["tool_item_stats"] = only("price_stats_filtered", "*", "item_id = 7")
ORACLES["tool_compare_items"] = only("compare_by_work_type", "*", "item_id IN (7, 21, 33, 144)")
ORACLES["tool_cooccurrences"] = only("cooccurrence_topk", "*", "item_id = 10")
ORACLES["tool_document_lines"] = only("document_lines", "line_id, document_id, ord, quantity, total, excluded", "document_id = 70")
oracle(
    "tool_client_documents",
    """SELECT document_id, number, document_date::VARCHAR AS document_date, document_total::DOUBLE AS document_total, coalesce(n_lines, 0) AS n_lines
    FROM m_docs LEFT JOIN lcnt USING (document_id) WHERE client_id = 37 AND document_date >= DATE '1995-06-01'
    ORDER BY m_docs.document_date DESC NULLS LAST, number DESC NULLS FIRST, document_id LIMIT 25""",
    COUNTS,
)
