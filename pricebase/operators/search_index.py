"""A stored inverted trigram index for searches, and the searches that read it.

The index holds each distinct text once: ``texts`` (text_id, text, n_distinct) and ``postings`` (gram,
text_id), both in batches; postings lie in buckets of their trigram and are sorted by it, so that a
search reads only the buckets and row groups of the few trigrams typed. Frequent trigrams spread
over several files.

Counting a text's postings bounds its word similarity from both sides: it is at most the shared part
of the term's trigrams and at least the trigram similarity of the whole texts. A search keeps the rows
whose upper bound reaches the k-th best lower bound; only those are compared exactly.

Texts never change: an edited label is a new text, and the rows that carry a text are joined to the
bounds by the text itself. A text nobody carries any more is therefore found but leads nowhere.
"""

from __future__ import annotations

from itertools import groupby
from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricebase.functions.text import search_literal, search_text, trigram_literal, trigrams
from pricebase.operators import search
from pricebase.session import materialized

BUCKETS = 32
ROUNDED = 1e-6  # scores are compared at six decimals


def text_id(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


# ---- the stored index -----------------------------------------------------------------


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the index; empty before its first batch."""
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(hadoop).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def stored_texts(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, f"{path}/texts", "text_id binary, text string, n_distinct int, batch int")


def add_texts(texts: DataFrame, path: str, batch: int) -> None:
    """Indexes the texts (column text, nulls ignored) that no other batch holds.

    A batch owns its partitions and overwrites them, so it can be run again after a failure; its
    texts are written last and make its postings count.
    """
    spark = texts.sparkSession
    earlier = stored_texts(spark, path).where(F.col("batch") != batch)
    distinct = texts.select("text").where(F.col("text").isNotNull()).distinct()
    fresh = materialized(
        distinct.withColumn("text_id", text_id(F.col("text")))
        .join(earlier.select("text_id"), "text_id", "left_anti")
        .withColumn("_grams", trigrams(F.col("text")))
    ).withColumn("batch", F.lit(batch))
    postings = fresh.select("text_id", "batch", F.explode("_grams").alias("gram")).withColumn(
        "bucket", F.pmod(F.crc32(F.col("gram").cast("binary")), F.lit(BUCKETS)).cast("int")
    )
    counted = fresh.select("text_id", "text", F.size("_grams").alias("n_distinct"), "batch")
    placed = postings.repartitionByRange("bucket", "gram", "text_id").sortWithinPartitions("bucket", "gram")
    for name, rows, parts in (("postings", placed, ["batch", "bucket"]), ("texts", counted, ["batch"])):
        (
            rows.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*parts)
            .parquet(f"{path}/{name}")
        )


# ---- reading it -----------------------------------------------------------------------


def certain_grams(plain: str) -> list[str]:
    """Trigrams of every text that contains ``plain``: those no neighbouring character can change."""
    grams: dict[str, None] = {}
    at = 0
    for in_word, run in groupby(plain.lower(), str.isalnum):
        word = "".join(run)
        begin, at = at, at + len(word)
        if in_word:
            padded = ("  " if begin else "") + word + (" " if at < len(plain) else "")
            grams.update((padded[i : i + 3], None) for i in range(len(padded) - 2))
    return list(grams)


def _postings(spark: SparkSession, path: str, grams: dict[str, list[str]], certain: dict[str, list[str]]) -> DataFrame:
    """(term, text_id, shared, sure): a text's number of the term's trigrams, and of those it must hold to contain it."""
    asked: dict[str, list[Column]] = {}
    for term, own in grams.items():
        for gram in own:
            entry = F.struct(F.lit(term).alias("term"), F.lit(int(gram in certain[term])).alias("must"))
            asked.setdefault(gram, []).append(entry)
    buckets = sorted({crc32(gram.encode()) % BUCKETS for gram in asked})
    posted = _stored(spark, f"{path}/postings", "text_id binary, gram string, batch int, bucket int").where(
        F.col("bucket").isin(buckets) & F.col("gram").isin(list(asked))
    )
    asking = F.create_map(*[c for gram, entries in asked.items() for c in (F.lit(gram), F.array(*entries))])
    return (
        posted.select("text_id", F.inline(F.element_at(asking, F.col("gram"))))
        .groupBy("term", "text_id")
        .agg(F.count(F.lit(1)).alias("shared"), F.sum("must").alias("sure"))
    )


def bounds(spark: SparkSession, path: str, terms: list[str], share: float) -> DataFrame:
    """(term, text, literal, low, most) of the indexed texts that may answer a term.

    All texts that contain the term (``literal``) or share at least ``share`` of its trigrams; their
    word similarity is between ``low`` and ``most``. A term too short to have a trigram of its own
    is looked for in all texts. A text may come twice for such a term.
    """
    typed = _typed(terms)
    plain = {t: search_literal(t) for t in typed}
    grams = {t: trigram_literal(plain[t]) for t in typed}
    certain = {t: certain_grams(plain[t]) for t in typed}
    facts = F.array(
        *[
            F.struct(
                F.lit(t).alias("term"),
                F.lit(plain[t]).alias("plain"),
                F.lit(len(grams[t])).alias("wanted"),
                F.lit(len(certain[t])).alias("needed"),
            )
            for t in typed
        ]
    )
    texts = stored_texts(spark, path)
    found = []
    if any(grams.values()):
        told = spark.range(1).select(F.inline(facts))
        hits = _postings(spark, path, grams, certain).join(F.broadcast(told), "term")
        enough = F.col("shared") >= share * F.col("wanted")
        may_contain = (F.col("needed") > 0) & (F.col("sure") == F.col("needed"))
        literal = may_contain & F.contains("text", "plain")
        kept = hits.where(enough | may_contain).join(texts, "text_id").where(enough | literal)
        union = F.col("wanted") + F.col("n_distinct") - F.col("shared")
        found.append(
            kept.select(
                "term",
                "text",
                literal.alias("literal"),
                (F.col("shared") / union).alias("low"),
                (F.col("shared") / F.col("wanted")).alias("most"),
            )
        )
    scanned = [t for t in typed if not certain[t]]
    if scanned:
        rows = texts.select("text", F.inline(facts)).where(F.col("needed") == 0)
        contained = rows.where(F.contains("text", "plain"))
        found.append(contained.select("term", "text", F.lit(True).alias("literal"), F.lit(0.0).alias("low"), F.lit(1.0).alias("most")))
    return found[0].unionByName(found[1]) if len(found) == 2 else found[0]


def _typed(terms: list[str]) -> list[str]:
    return list(dict.fromkeys(t.strip() for t in terms))


# ---- searches --------------------------------------------------------------------------


def _hopeful(reached: DataFrame, key: str, limit: int) -> DataFrame:
    """Keys that can be among the ``limit`` best of a term.

    ``reached``: term, key, sure (it answers the term for certain), low and most (bounds of its score).
    """
    known = reached.groupBy("term", key).agg(
        F.max("sure").alias("sure"), F.max("low").alias("low"), F.max("most").alias("most")
    )
    known = materialized(known)
    best = search.top_per_term(known.where("sure"), [F.col("low").desc()], limit)
    bar = best.groupBy("term").agg(F.when(F.count(F.lit(1)) == limit, F.min("low")).alias("bar"))
    hopeful = known.join(bar, "term", "left").where(F.col("most") >= F.coalesce("bar", F.lit(0.0)) - ROUNDED)
    return materialized(hopeful.select(key).distinct())


def _spread(rows: DataFrame) -> DataFrame:
    """Few rows that are dear to compare: over all cores, however small they are."""
    return materialized(rows.repartition(rows.sparkSession.sparkContext.defaultParallelism))


def item_texts(items: DataFrame, linked_texts: DataFrame) -> DataFrame:
    """The texts an item search reads: printed labels, normalised labels as stored and plain, wordings."""
    labels = [search_text(F.col("label_print")), F.col("label_norm"), search_text(F.col("label_norm"))]
    return items.select(F.explode(F.array(*labels)).alias("text")).unionByName(
        linked_texts.select(F.col("search_text").alias("text"))
    )


def item_search(
    items: DataFrame,
    linked_texts: DataFrame,
    path: str,
    terms: list[str],
    limit: int = 10,
    thresholds: tuple[float, float, float] = search.ITEM_THRESHOLDS,
) -> DataFrame:
    """The best items of each term, as ``search.item_search``; ``path`` holds ``item_texts`` at least."""
    floor = min(thresholds)
    near = materialized(bounds(items.sparkSession, path, terms, floor))
    active = items.where(F.col("active"))
    sides = F.array(
        *[
            F.struct(text.alias("text"), *[F.lit(v).alias(n) for n, v in (("threshold", bar), ("scored", scored), ("plain", plain))])
            for text, bar, scored, plain in (
                (search_text(F.col("label_print")), thresholds[0], True, True),
                (F.col("label_norm"), thresholds[1], True, False),
                (search_text(F.col("label_norm")), 2.0, False, True),
            )
        ]
    )
    labelled = active.select("item_id", F.inline(sides)).join(near, "text")
    by_label = labelled.select(
        "term",
        "item_id",
        ((F.col("plain") & F.col("literal")) | (F.col("low") > F.col("threshold"))).alias("sure"),
        F.when(F.col("scored"), F.col("low")).otherwise(0.0).alias("low"),
        F.when(F.col("scored"), F.col("most")).otherwise(floor).alias("most"),
    )
    wordings = materialized(linked_texts.select("item_id", F.col("search_text").alias("text")).distinct())
    by_wording = wordings.join(near, "text").select(
        "term",
        "item_id",
        (F.col("literal") | (F.col("low") > thresholds[2])).alias("sure"),
        F.lit(0.0).alias("low"),
        # labels that are not near the term are less similar than this
        F.lit(floor).alias("most"),
    )
    coded = search.with_terms(active, terms).where(F.contains(F.lower("code"), F.lower("term")))
    by_code = coded.select("term", "item_id", F.lit(True).alias("sure"), F.lit(1.0).alias("low"), F.lit(1.0).alias("most"))
    hopeful = _hopeful(by_label.unionByName(by_wording).unionByName(by_code), "item_id", limit)
    # other wordings cannot answer any of the terms
    possible = near.where(F.col("literal") | (F.col("most") >= thresholds[2])).select("text").distinct()
    wordings = wordings.join(possible, "text", "left_semi")
    return search.item_search(
        _spread(items.join(hopeful, "item_id", "left_semi")),
        _spread(wordings.withColumnRenamed("text", "search_text").join(hopeful, "item_id", "left_semi")),
        terms,
        limit,
        thresholds,
    )


def client_texts(clients: DataFrame, aliases: DataFrame) -> DataFrame:
    names = clients.select(search_text(F.col("name")).alias("text"))
    return names.unionByName(aliases.select(search_text(F.col("alias")).alias("text")))


def client_search(
    clients: DataFrame, aliases: DataFrame, documents: DataFrame, path: str, terms: list[str], limit: int = 10
) -> DataFrame:
    """Clients by name or remembered spelling, as ``search.client_search``; ``path`` holds ``client_texts``."""
    floor = min(search.CLIENT_WORD, search.CLIENT_WHOLE)
    near = materialized(bounds(clients.sparkSession, path, terms, floor))
    named = clients.select("client_id", search_text(F.col("name")).alias("text")).join(near, "text")
    by_name = named.select(
        "term", "client_id", (F.col("literal") | (F.col("low") > search.CLIENT_WHOLE)).alias("sure"), "low", "most"
    )
    spelled = aliases.select("client_id", search_text(F.col("alias")).alias("text")).join(near, "text")
    by_alias = spelled.select(
        "term",
        "client_id",
        (F.col("low") > search.CLIENT_WORD).alias("sure"),
        F.lit(0.0).alias("low"),
        F.lit(floor).alias("most"),
    )
    hopeful = _hopeful(by_name.unionByName(by_alias), "client_id", limit)
    return search.client_search(
        _spread(clients.join(hopeful, "client_id", "left_semi")),
        _spread(aliases.join(hopeful, "client_id", "left_semi")),
        documents,
        terms,
        limit,
    )
