"""The queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricebase.llm import byte_bpe, exact_dedup, html_text, license_scan, ngram_join, order_minhash, packing, prefix_trie, quality, quality_rules, sharding, token_alignment, url_filter

URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows.select(*columns) if columns else rows


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(_table(spark, sf_dir, "pages", "page_id", "url"), rules)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = byte_bpe.encode(_table(spark, sf_dir, "documents", "doc_id", "text"), path, pattern)
    return byte_bpe.decode(encoded, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    return packing.pack(_table(spark, sf_dir, "documents", "doc_id", "text"), path, pattern, 2048, added_tokens=True)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    trees = quality.train(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, trees).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text"), keep="largest")


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edited_fingerprints(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(_table(spark, sf_dir, "documents", "doc_id", "text"))
    best = F.array_max(F.transform("notices", lambda n: F.struct(n["coverage"], n["matched_words"], -n["first_word"], n["license"], n["last_word"])))
    return found.select(
        "doc_id",
        F.size("notices").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct("notices.license")), ",").alias("licenses"),
        best["license"].alias("license"),
        best["coverage"].alias("coverage"),
        (-best["col3"]).alias("first_word"),
        best["last_word"].alias("last_word"),
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(_table(spark, sf_dir, "documents", "doc_id", "text"), 16)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = prefix_trie.turn_lists(_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    return prefix_trie.trie(prefix_trie.with_shared_opening(lists, every=100, choices=6))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    path_a, path_b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    rows = token_alignment.aligned(_table(spark, sf_dir, "documents", "doc_id", "text"), path_a, public_tokenizers.PATTERN, path_b)
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest)


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    model = quality_rules.train(docs, _table(spark, sf_dir, "labels"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return quality_rules.judge(docs, model).select("doc_id", *counts, "base_failed", "probability", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_packing": op3_packing,
    "op4_html_text": op4_html_text,
    "op5_quality": op5_quality,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_order_minhash": op7_order_minhash,
    "op8_license_scan": op8_license_scan,
    "op9_sharding": op9_sharding,
    "op10_ngram_join": op10_ngram_join,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_token_alignment": op12_token_alignment,
    "op13_quality_rules": op13_quality_rules,
}

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

SQL: dict[str, str] = {
    "op1_url_filter": f"""
        WITH rules(rule_host, rule_path, verdict) AS (VALUES {_RULES}),
        urls AS (
            SELECT page_id,
                   translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
            FROM pages),
        fits AS (
            SELECT page_id, host, path, rule_host || rule_path AS rule, verdict,
                   row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS nth
            FROM urls LEFT JOIN rules
              ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE nth = 1""",
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op10_ngram_join": r"""
        WITH RECURSIVE split AS (
            SELECT doc_id, list_filter(string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
            FROM documents),
        grams AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS gram
            FROM split),
        sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
        common AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
            FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (
            SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
            WHERE 100 * c.n >= 75 * (x.n + y.n - c.n)),
        reach(doc_id, other) AS (
            SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
        SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
        FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id""",
    # crc32 of the decimal id: each byte, then eight shifts
    "op11_prefix_trie": """
        WITH own AS (
            SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST,
                   md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
        hashed AS (
            SELECT conv_id, turns, xor(list_reduce(flatten(list_transform(string_split(conv_id::VARCHAR, ''),
                       lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda c, x:
                       CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END,
                       4294967295::BIGINT), 4294967295::BIGINT) % 6 AS h
            FROM own),
        rebuilt AS (
            SELECT x.conv_id, list_concat(coalesce(y.turns, [])[1:x.h], x.turns[x.h + 1:]) AS turns
            FROM hashed x LEFT JOIN own y ON y.conv_id = x.conv_id - x.conv_id % 100),
        starts AS (SELECT conv_id, len(turns) AS n, unnest(range(0, len(turns) + 1)) AS depth, turns FROM rebuilt),
        nodes AS (
            SELECT depth, turns[1:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
                   sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
            FROM starts GROUP BY ALL),
        parents AS (
            SELECT c.depth, c.path, c.conv_id, c.n_convs, c.ends_sha256, p.conv_id AS parent_conv_id
            FROM nodes c LEFT JOIN nodes p ON p.depth = c.depth - 1 AND p.path = c.path[1:c.depth - 1]),
        children AS (SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
        counted AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM parents n LEFT JOIN children c ON c.depth = n.depth AND c.path = n.path),
        subtrees AS (
            SELECT top AS depth, path[1:top] AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
            FROM (SELECT path, n_children, (n_convs - 1) * coalesce(length(path[depth].text), 0) AS saved, unnest(range(0, depth + 1)) AS top FROM counted)
            GROUP BY ALL)
        SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
        FROM counted JOIN subtrees USING (depth, path)""",
}
