"""Typo-tolerant search of items, lines, documents and clients.

A request is one or a few strings typed by a user: each becomes a literal, and the catalogue is
scanned once with cheap conditions first (literal containment, number of shared trigrams) and the
exact word similarity last. Only the k best rows per term leave a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricebase.functions.numbers import half_up
from pricebase.functions.text import (
    holds_enough,
    jaccard,
    padded_words,
    search_literal,
    search_text,
    shared_trigrams,
    trigram_literal,
    trigram_sequence,
    word_similarity,
)
from pricebase.session import materialized, written

ITEM_THRESHOLDS = (0.3, 0.3, 0.4)
GRID_THRESHOLDS = (0.35, 0.35, 0.4)
DOCUMENT_THRESHOLD = 0.3
LINE_THRESHOLD = 0.35
CLIENT_WORD, CLIENT_WHOLE = 0.3, 0.2


def _terms(terms: list[str]) -> Column:
    """The typed terms as an array literal of (term, plain, grams)."""
    entries = []
    for term in terms:
        plain = search_literal(term)
        grams = trigram_literal(plain)
        gram_array = (
            F.array(*[F.lit(g) for g in grams]) if grams else F.array().cast("array<string>")
        )
        entries.append(
            F.struct(
                F.lit(term.strip()).alias("term"), F.lit(plain).alias("plain"), gram_array.alias("grams")
            )
        )
    return F.array(*entries)


def with_terms(rows: DataFrame, terms: list[str]) -> DataFrame:
    """Each row once per typed term (columns term, plain, term_grams)."""
    return rows.withColumn("_t", F.explode(_terms(terms))).select(
        "*", "_t.term", "_t.plain", F.col("_t.grams").alias("term_grams")
    ).drop("_t")


def resembling(texts: DataFrame, text: str, terms: list[str], threshold: float, literal: bool = True) -> DataFrame:
    """Each row once per term its text resembles (or contains, where ``literal``).

    Most texts stop at the shared-trigram bound, which needs no trigrams of the text; only those of
    the others are built.
    """
    rows = with_terms(texts.withColumn("_padded", padded_words(F.col(text))), terms)
    contained = F.contains(text, "plain") if literal else F.lit(False)
    possible = rows.where(contained | holds_enough(F.col("term_grams"), F.col("_padded"), threshold))
    sequenced = computed_once(possible, _seq=trigram_sequence(F.col(text)))
    near = sequenced.where(contained | (word_similarity(F.col("term_grams"), F.col("_seq")) > threshold))
    return near.drop("_padded", "_seq")


def spread(rows: DataFrame) -> DataFrame:
    """Rows that are dear to compare: over all cores, in however few files they are stored."""
    return rows.repartition(*rows.columns)


def item_ids_by_wording(linked_texts: DataFrame, terms: list[str], threshold: float) -> DataFrame:
    """(term, item_id) found through the raw designations linked to an item.

    Each distinct wording is compared once, however many lines carry it.
    """
    pairs = linked_texts.select("item_id", "search_text").distinct()
    wordings = spread(pairs.select("search_text").distinct())
    found = resembling(wordings, "search_text", terms, threshold).select("term", "search_text")
    return pairs.join(found, "search_text").select("term", "item_id").distinct()


def computed_once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds costly columns behind an unfolded array, so that later filters do not repeat them."""
    packed = F.struct(*[value.alias(name) for name, value in columns.items()])
    return rows.select("*", F.inline(F.array(packed)))


def score_items(
    items: DataFrame,
    linked_texts: DataFrame,
    terms: list[str],
    thresholds: tuple[float, float, float] = ITEM_THRESHOLDS,
) -> DataFrame:
    """Active items eligible for each term, with their score.

    The normalised label is compared as stored, not unaccented. Items of the same labels are compared
    once; labels that cannot pass (no literal
    hit, too few shared trigrams) leave before any similarity is computed.
    """
    print_threshold, norm_threshold, line_threshold = thresholds
    active = items.where(F.col("active"))
    labels = spread(active.select("label_print", "label_norm").distinct())
    rows = with_terms(
        labels.withColumn("_print", search_text(F.col("label_print")))
        .withColumn("_padded_print", padded_words(F.col("_print")))
        .withColumn("_padded_norm", padded_words(F.col("label_norm"))),
        terms,
    )
    grams = F.col("term_grams")
    literal = F.contains("_print", "plain") | F.contains(search_text(F.col("label_norm")), F.col("plain"))
    code_hit = F.coalesce(F.contains(F.lower("code"), F.lower("term")), F.lit(False))
    by_wording = materialized(item_ids_by_wording(linked_texts, terms, line_threshold))
    # labels that a term reaches through the wordings or the code of an item
    reached = by_wording.join(active, "item_id").select("term", _label().alias("_label")).unionByName(
        with_terms(active, terms).where(code_hit).select("term", _label().alias("_label"))
    )
    asked = reached.distinct().withColumn("_asked", F.lit(True))
    possible = rows.withColumn("_label", _label()).join(asked, ["term", "_label"], "left").where(
        F.col("_asked")
        | literal
        | holds_enough(grams, F.col("_padded_print"), print_threshold)
        | holds_enough(grams, F.col("_padded_norm"), norm_threshold)
    )
    measured = computed_once(
        computed_once(
            possible, _seq_print=trigram_sequence(F.col("_print")), _seq_norm=trigram_sequence(F.col("label_norm"))
        ),
        _in_print=word_similarity(grams, F.col("_seq_print")),
        _in_norm=word_similarity(grams, F.col("_seq_norm")),
        _literal=F.coalesce(literal, F.lit(False)),
        _whole=jaccard(grams, F.array_distinct("_seq_print")),
    ).select("term", "_label", "_in_print", "_in_norm", "_literal", "_whole")
    return (
        active.withColumn("_label", _label())
        .join(measured, "_label")
        .join(by_wording.withColumn("_worded", F.lit(True)), ["term", "item_id"], "left")
        .where(
            F.col("_worded")
            | code_hit
            | F.col("_literal")
            | (F.col("_in_print") > print_threshold)
            | (F.col("_in_norm") > norm_threshold)
        )
        .withColumn("_code", F.when(code_hit, 1.0).otherwise(0.0))
        .withColumn("score", F.greatest("_code", "_in_print", "_in_norm", "_whole"))
        .select("term", *items.columns, "score")
    )


def _label() -> Column:
    """Both labels of an item as one key, also where one is missing."""
    return F.to_json(F.struct("label_print", "label_norm"))


def top_per_term(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The best rows of each term; every task keeps at most ``limit`` per term before the shuffle."""
    best = Window.partitionBy("term").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)


def item_search(
    items: DataFrame,
    linked_texts: DataFrame,
    terms: list[str],
    limit: int = 10,
    thresholds: tuple[float, float, float] = ITEM_THRESHOLDS,
) -> DataFrame:
    scored = score_items(items, linked_texts, terms, thresholds).withColumn(
        "score", half_up(F.col("score"), 6)
    )
    order = [F.col("score").desc(), F.col("label_print"), F.col("item_id")]
    return top_per_term(scored, order, limit).select(
        "term", "rank", "item_id", "code", "label_print", "score"
    )


def grid_search(items: DataFrame, linked_texts: DataFrame, term: str) -> DataFrame:
    """Ids of the items the grid keeps for a search term."""
    return score_items(items, linked_texts, [term], GRID_THRESHOLDS).select("item_id")


def client_search(
    clients: DataFrame,
    aliases: DataFrame,
    documents: DataFrame,
    terms: list[str],
    limit: int = 10,
) -> DataFrame:
    """Clients by name or remembered spelling, with their documents and cumulated amount."""
    names = (
        spread(clients.select("client_id", "name"))
        .withColumn("_name", search_text(F.col("name")))
        .withColumn("_padded", padded_words(F.col("_name")))
    )
    grams = F.col("term_grams")
    spellings = spread(aliases.select("alias", "client_id")).withColumn("_alias", search_text(F.col("alias")))
    spelled = materialized(
        resembling(spellings, "_alias", terms, CLIENT_WORD, literal=False)
        .select("term", "plain", "term_grams", "client_id")
        .distinct()
        .withColumn("_spelled", F.lit(True))
    )
    shared = shared_trigrams(grams, F.col("_padded"))
    named = F.coalesce(
        F.contains("_name", "plain")
        | (shared >= CLIENT_WORD * F.size(grams))
        | (shared > CLIENT_WHOLE * F.size(grams)),
        F.lit(False),
    )
    # names leave before they meet the spellings, and only the names of those met are looked up
    by_name = with_terms(names, terms).where(named).join(
        spelled.select("term", "client_id", "_spelled"), ["term", "client_id"], "left"
    )
    by_alias = names.join(spelled, "client_id").where(~named)
    measured = computed_once(
        computed_once(by_name.unionByName(by_alias), _seq=trigram_sequence(F.col("_name"))),
        _sure=F.coalesce("_spelled", F.lit(False)) | F.contains("_name", "plain"),
        _word=word_similarity(grams, F.col("_seq")),
        _whole=jaccard(grams, F.array_distinct("_seq")),
    )
    found = (
        measured.where(
            F.col("_sure") | (F.col("_word") > CLIENT_WORD) | (F.col("_whole") > CLIENT_WHOLE)
        )
        .withColumn("score", half_up(F.greatest("_word", "_whole"), 6))
        .select("term", "client_id", "name", "score")
    )
    totals = client_totals(documents)
    order = [F.col("score").desc(), F.col("n_documents").desc(), F.col("client_id")]
    return top_per_term(
        found.join(totals, "client_id", "left").fillna(0, ["n_documents", "total_amount"]),
        order,
        limit,
    ).select("term", "rank", "client_id", "name", "n_documents", "total_amount", "score")


def client_totals(documents: DataFrame) -> DataFrame:
    """Documents and cumulated amount per client."""
    return (
        documents.where(F.col("client_id").isNotNull())
        .groupBy("client_id")
        .agg(
            F.count(F.lit(1)).alias("n_documents"),
            F.sum("document_total").cast("double").alias("total_amount"),
        )
    )


def search_documents(
    documents: DataFrame, clients: DataFrame, aliases: DataFrame, term: str
) -> DataFrame:
    """Documents by client name or spelling, site title or number (history search)."""
    named = clients.withColumn("_name", search_text(F.col("name")))
    names = resembling(named, "_name", [term], DOCUMENT_THRESHOLD)
    spellings = aliases.withColumn("_alias", search_text(F.col("alias")))
    spelled = resembling(spellings, "_alias", [term], DOCUMENT_THRESHOLD, literal=False)
    matching = (
        names.select("client_id")
        .unionByName(spelled.select("client_id"))
        .distinct()
        .withColumn("_client", F.lit(True))
    )
    plain = F.lit(search_literal(term))
    own = F.contains(search_text(F.coalesce("site_title", F.lit(""))), plain) | F.contains(
        F.lower(F.coalesce("number", F.lit(""))), F.lit(term.strip().lower())
    )
    return (
        documents.join(matching, "client_id", "left")
        .where(F.coalesce("_client", F.lit(False)) | own)
        .drop("_client")
    )


def search_lines(history_rows: DataFrame, term: str) -> DataFrame:
    """History lines by client, designation or item label. Each distinct wording is compared once."""
    wordings = spread(history_rows.select("search_text").distinct())
    # written, so that the lines do not move to meet a few wordings
    near = written(
        resembling(wordings, "search_text", [term], LINE_THRESHOLD).select("search_text", F.lit(True).alias("_near"))
    )
    plain = F.lit(search_literal(term))
    hit = (
        F.col("_near")
        | F.contains(search_text(F.coalesce("client", F.lit(""))), plain)
        | F.contains(search_text(F.coalesce("item_label", F.lit(""))), plain)
    )
    return history_rows.join(near, "search_text", "left").where(hit).select(*history_rows.columns)
