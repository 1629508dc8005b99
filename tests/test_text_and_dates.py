import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pricebase.functions.dates import date_from_file_name, date_from_text, recovered
from pricebase.functions.text import (
    code_slug,
    is_administrative,
    search_text,
    similarity,
    trigram_literal,
    trigram_sequence,
    unit_compatible,
    word_similarity,
)


def sequence(text):
    out, word = [], ""
    for char in text.lower() + " ":
        if char.isalnum():
            word += char
        elif word:
            padded = f"  {word} "
            out += [padded[i : i + 3] for i in range(len(word) + 1)]
            word = ""
    return out


def best_run(term, text):
    wanted, grams = set(sequence(term)), sequence(text)
    best = 0.0
    for i in range(len(grams)):
        for j in range(i, len(grams)):
            run = set(grams[i : j + 1])
            best = max(best, len(wanted & run) / len(wanted | run))
    return best


def test_word_similarity_equals_every_run(spark):
    draw = random.Random(7)
    words = ["pose", "poser", "dalle", "dale", "mur", "murs", "sud", "croix", "bois"]
    rows = [
        (" ".join(draw.choices(words, k=draw.randint(1, 2))), " ".join(draw.choices(words, k=draw.randint(0, 6))))
        for _ in range(150)
    ]
    frame = spark.createDataFrame(rows, "term string, text string").select(
        "term", "text",
        word_similarity(F.array_distinct(trigram_sequence("term")), trigram_sequence("text")).alias("s"),
    )
    for r in frame.collect():
        assert r.s == pytest.approx(best_run(r.term, r.text))


def test_typos_are_found(spark):
    rows = [("pacivation", "passivation de poutrelle"), ("croi du sud", "residence croix du sud")]
    frame = spark.createDataFrame(rows, "term string, text string")
    got = frame.select(
        word_similarity(F.array_distinct(trigram_sequence("term")), trigram_sequence("text")).alias("s")
    ).collect()
    assert [r.s > 0.35 for r in got] == [True, True]


def test_similarity_and_normalisation(spark):
    row = spark.range(1).select(
        similarity(F.lit("Béton armé"), F.lit("béton armé")).alias("same"),
        similarity(F.lit(""), F.lit("x")).alias("empty"),
        search_text(F.lit("Œuvre ÉLÉGANTE ça")).alias("plain"),
        code_slug(F.lit("dé.. molir/ mur!")).alias("slug"),
    ).first()
    assert (row.same, row.empty) == (1.0, 0.0)
    assert row.plain == "oeuvre elegante ca"
    assert row.slug == "D-MOLIR-MUR"
    assert trigram_literal("ab c") == ["  a", " ab", "ab ", "  c", " c "]


def test_unit_compatibility_table(spark):
    rows = [(None, None), ("m2", None), (None, "m2"), ("m2", "m2"), ("m2", "ml"), ("ens", "forfait")]
    got = spark.createDataFrame(rows, "l string, i string").select(
        unit_compatible(F.col("l"), F.col("i")).alias("ok")
    )
    assert [r.ok for r in got.collect()] == [True, True, False, True, False, True]


def test_administrative_wordings(spark):
    texts = ["retenue de garantie 5%", "tva 20", "tvalise", "option porte", "sous-total lot 3", "lot 3 beton", "dalle", "p.m."]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(is_administrative(F.col("t")).alias("a"))
    assert [r.a for r in got.collect()] == [True, True, False, True, True, True, False, True]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("FREJUS le 10/04/2026", dt.date(2026, 4, 10)),
        ("2025-03-01T00:00:00", dt.date(2025, 3, 1)),
        ("1er mars 2025", dt.date(2025, 3, 1)),
        ("Le 12 Février 2024", dt.date(2024, 2, 12)),
        ("avril 2026", dt.date(2026, 4, 1)),
        ("2026-04", dt.date(2026, 4, 1)),
        ("13.03.24", dt.date(2024, 3, 13)),
        ("31/02/2025", None),
        ("10/04/1999", None),
        ("31/02/2025 puis 1er mars 2025", None),
        ("12 fois 2024 puis mai 2025", None),
        ("", None),
        (None, None),
    ],
)
def test_dates_in_text(spark, text, expected):
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(date_from_text(F.col("t"), F.lit(2027)).alias("d")).first().d == expected


@pytest.mark.parametrize(
    ("name", "expected"),
    [
        ("Devis-Martin_ord2_rev00_130324.pdf", dt.date(2024, 3, 13)),
        ("Trame DPGF lot2 20-01-21.xlsx", dt.date(2021, 1, 20)),
        ("2024 11 06 OS signé.pdf", dt.date(2024, 11, 6)),
        ("20190390-DPGF Definitif.ods", None),
        ("M2026051- Lotn02.pdf", None),
        ("DEVIS N°1425.pdf", None),
        ("310224 puis 2024_05.pdf", dt.date(2024, 5, 1)),
    ],
)
def test_dates_in_file_names(spark, name, expected):
    frame = spark.createDataFrame([(name,)], "t string")
    assert frame.select(date_from_file_name(F.col("t"), F.lit(2027)).alias("d")).first().d == expected


def test_date_provenance(spark):
    rows = [("2024-05-06", "x_130324.pdf"), ("6 mai 2024", "x_130324.pdf"), (None, "x_130324.pdf"), (None, "x.pdf")]
    frame = spark.createDataFrame(rows, "t string, f string").select(
        recovered(F.col("t"), F.col("f"), F.lit(2027)).alias("r")
    )
    assert [r.r.date_source if r.r else None for r in frame.collect()] == ["document", "raw", "fichier", None]
