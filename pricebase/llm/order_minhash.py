"""Fingerprints by order MinHash.

The k-mers are runs of five words, numbered by occurrence so that repeats count. Their hashes deal them into bins (one
permutation serves as many hash functions); in every bin the least two are selected, put back into text order, and the
pair is hashed. Two texts agree in a bin if they share its selected k-mers in the same order, so likeness falls with
edits and with rearranged text.

Only DataFrame functions are used, and all of them work inside a row: nothing of a text is exploded or shuffled. An
array that is read inside a lambda stands in a column of its own and is read at least twice there: then the optimizer
does not inline it into the lambda, where it would be built again for every element.

Defined results: a null or empty text has an empty fingerprint, alike (1.0) to empty ones only; a text of fewer words
is one k-mer; words longer than 24 characters count as several, ideographs as words; repeated rows are fingerprinted
separately; rows without id come last in descending order, rows with one id in the order of their texts; a single
document is its own next document; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricebase.llm.common import prepared, range_of, sampled_splitters, shuffle_partitions

WORDS, BINS, SELECTED = 5, 32, 2
#: Ranges of ids per shuffle partition; a window holds one range.
RANGES_PER_PARTITION = 2
_TOKEN = r"[⺀-鿿가-힯]|[^\s⺀-鿿가-힯]{1,24}"


def with_fingerprint(rows: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: an array of longs, one per bin that has k-mers; the low bits are the bin."""
    kept = rows.columns

    def step(frame: DataFrame, name: str, value: Column) -> DataFrame:
        return frame.withColumn(name, value)

    def at(name: str, i: Column) -> Column:
        return F.get(F.col(name), i)

    words = step(rows, "_words", F.regexp_extract_all(F.col(text), F.lit(_TOKEN), F.lit(0)))
    hashed = step(words, "_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    n = F.size("_hashes")
    long = F.transform(
        F.sequence(F.lit(0), n - WORDS),
        lambda i: F.struct(F.xxhash64(*[at("_hashes", i + k) for k in range(WORDS)]).alias("h"), i.alias("pos")),
    )
    short = F.array(F.struct(F.xxhash64(F.col("_hashes")).alias("h"), F.lit(0).alias("pos")))
    none = F.slice(short, 1, 0)
    kmers = step(hashed, "_kmers", F.sort_array(F.when(n >= WORDS, long).when(n > 0, short).otherwise(none)))
    # where runs of equal k-mers start; the place in its run is the occurrence number
    runs = step(kmers, "_runs", _starts("_kmers", "h"))
    ended = F.size("_kmers")
    numbered = F.transform(
        F.col("_runs"),
        lambda s, r: F.transform(
            F.slice(F.col("_kmers"), s + 1, F.coalesce(F.get(F.col("_runs"), r + 1), ended) - s),
            lambda x, o: _dealt(F.xxhash64(x["h"], o), x["pos"]),
        ),
    )
    dealt = step(runs, "_dealt", F.sort_array(F.flatten(numbered)))
    bins = step(dealt, "_bins", _starts("_dealt", "bin"))
    ended = F.size("_dealt")
    selected = F.transform(
        F.col("_bins"),
        lambda s, r: F.slice(
            F.col("_dealt"), s + 1, F.least(F.lit(SELECTED), F.coalesce(F.get(F.col("_bins"), r + 1), ended) - s)
        ),
    )
    # a bin and the hash of its selected k-mers, in text order
    entry = F.transform(
        selected,
        lambda own: F.xxhash64(
            F.transform(F.sort_array(F.transform(own, lambda x: F.struct(x["pos"], x["g"]))), lambda y: y["g"])
        ).bitwiseAND(F.lit(~(BINS - 1))).bitwiseOR(F.get(own, F.lit(0))["bin"]),
    )
    return step(bins, out, entry).select(*kept, out)


def _dealt(g: Column, pos: Column) -> Column:
    return F.struct(g.bitwiseAND(F.lit(BINS - 1)).alias("bin"), g.alias("g"), pos.alias("pos"))


def _starts(name: str, field: str) -> Column:
    """The places where the field differs from its predecessor's."""
    size = F.size(name)
    places = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(
        places, lambda i: (i == 0) | (F.get(F.col(name), i)[field] != F.get(F.col(name), i - 1)[field])
    )


def likeness(a: str, b: str) -> Column:
    """Bins that agree, of those that either text has; 1 for two empty fingerprints."""

    def bins(name: str) -> Column:
        return F.transform(name, lambda x: x.bitwiseAND(F.lit(BINS - 1)))

    either = F.size(F.array_union(bins(a), bins(b)))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def as_string(name: str) -> Column:
    return F.array_join(F.transform(name, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``next_<column>`` of the next row in descending id (after the last: the first).

    Ids are range-partitioned; the first row of a range, its greatest id, is also put behind the range above it.
    """
    ids = docs.select("doc_id")
    ranges = RANGES_PER_PARTITION * shuffle_partitions(docs.sparkSession)
    splitters = sampled_splitters(ids, ["doc_id"], ranges)
    part = range_of(splitters, [F.col("doc_id")])
    # one row per range
    greatest = {r["part"]: r["top"] for r in ids.groupBy(part.alias("part")).agg(F.max("doc_id").alias("top")).collect()}
    used = sorted(greatest)
    above = {p: used[(i + 1) % len(used)] for i, p in enumerate(used)}  # of the highest range: the lowest
    parts = range(len(splitters) + 1)
    tops = F.array(*[F.lit(greatest.get(p)).cast("long") for p in parts])
    behind = F.array(*[F.lit(above.get(p)).cast("int") for p in parts])
    own = F.struct(F.col("_part").alias("part"), F.lit(False).alias("behind"))
    again = F.struct(F.get(behind, F.col("_part")).alias("part"), F.lit(True).alias("behind"))
    is_top = F.col("doc_id").eqNullSafe(F.get(tops, F.col("_part")))
    placed = docs.withColumn("_part", part).withColumn("_place", F.explode(F.when(is_top, F.array(own, again)).otherwise(F.array(own))))
    placed = placed.select(*docs.columns, "_place.part", "_place.behind").repartitionById(len(splitters) + 1, "part")
    order = Window.partitionBy("part").orderBy("behind", F.col("doc_id").desc_nulls_last(), "text")
    led = placed.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return led.where("not behind").drop("part", "behind")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, fingerprint (hex)."""
    prepared(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return with_fingerprint(rows, "text", "sig").select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), as_string("sig").alias("fingerprint")
    )


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    In the edited text the last third of the characters is replaced by the first as many of the next document.
    """
    prepared(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = with_next(with_fingerprint(rows, "text", "sig"), ["text", "sig"])
    n = F.length("text")
    counted = signed.withColumn("n_chars", n.cast("long")).withColumn("cut", F.floor(n / 3).cast("int"))
    edited = F.concat(F.left("text", F.length("text") - F.col("cut")), F.left("next_text", F.col("cut")))
    changed = counted.select("doc_id", "n_chars", "sig", "next_sig", edited.alias("edited"))
    both = with_fingerprint(changed.withColumn("edited_sha256", F.sha2("edited", 256)), "edited", "edited_sig")
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_string("sig").alias("fingerprint"),
        as_string("edited_sig").alias("edited_fingerprint"),
        likeness("sig", "edited_sig").alias("near_edited"),
        likeness("sig", "next_sig").alias("near_next"),
    )
