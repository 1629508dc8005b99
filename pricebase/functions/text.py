"""Text normalisation, trigram similarity and the predicates on wordings and units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and their plain form.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
LIGATURES = (("œ", "oe"), ("æ", "ae"), ("ß", "ss"))

# Wordings that are never a priced work, on unaccented lower-case text.
ADMINISTRATIVE_WORDINGS = (
    r"retenue de garantie",
    r"revision de prix",
    r"actualisation",
    r"remise",
    r"rabais",
    r"escompte",
    r"acompte",
    r"sous.?total",
    r"^total",
    r"^tva\b",
    r"pour memoire",
    r"\bp\.?m\.?\b",
    r"compte prorata",
    r"^option\b",
    r"^variante\b",
    r"arrondi",
    r"report\b",
    r"deja factur",
    r"penalit",
    r"avance forfaitaire",
    r"retenue\b",
    r"^lot \d",
    r"^chapitre",
    r"^recapitulatif",
    r"^montant\b",
    r"^base\b",
    r"^tranche",
)
LUMP_UNITS = ("ens", "forfait")
CATEGORY_CODE = r"^[A-Z0-9.]{2,20}$"


def search_text(value: Column) -> Column:
    """Lower case without accents."""
    plain = F.translate(F.lower(value), ACCENTED, PLAIN)
    for ligature, letters in LIGATURES:
        plain = F.replace(plain, F.lit(ligature), F.lit(letters))
    return plain


def search_literal(term: str) -> str:
    """The same normalisation for a term typed by a user."""
    plain = term.strip().lower().translate(str.maketrans(ACCENTED, PLAIN))
    for ligature, letters in LIGATURES:
        plain = plain.replace(ligature, letters)
    return plain


def without_nul(value: Column) -> Column:
    """Drop NUL characters, raw or JSON-escaped; an escaped backslash before ``u0000`` is none."""
    raw = F.replace(value, F.lit("\u0000"), F.lit(""))
    cleaned = F.regexp_replace(raw, r"(?<!\\)((?:\\\\)*)\\u0000", "$1")
    return F.when(F.contains(raw, F.lit("\\u0000")), cleaned).otherwise(raw)


def is_administrative(text: Column) -> Column:
    return text.rlike("|".join(ADMINISTRATIVE_WORDINGS))


def is_lump_unit(unit: Column) -> Column:
    """NULL for an unknown unit: such a line never feeds a price."""
    return unit.isin(*LUMP_UNITS)


def unit_compatible(line_unit: Column, item_unit: Column) -> Column:
    both_lump = line_unit.isin(*LUMP_UNITS) & item_unit.isin(*LUMP_UNITS)
    known = F.coalesce((line_unit == item_unit) | both_lump, F.lit(False))
    return item_unit.isNull() | known


def _words(value: Column) -> Column:
    return F.filter(F.split(F.lower(value), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def trigram_sequence(value: Column) -> Column:
    """Trigrams in reading order: each word is padded by two blanks before and one after."""
    return F.flatten(
        F.transform(
            _words(value),
            lambda w: F.transform(
                F.sequence(F.lit(1), F.length(w) + 1),
                lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)),
            ),
        )
    )


def padded_words(value: Column) -> Column:
    """The words of a text between blanks: it holds a trigram of a term where this string contains it."""
    return F.concat(F.lit("  "), F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]+", "  "), F.lit(" "))


def holds_enough(term_grams: Column, padded: Column, threshold: float) -> Column:
    """``shares_enough`` on ``padded_words``: no trigram of the text is built."""
    return shared_trigrams(term_grams, padded) >= threshold * F.size(term_grams)


def shared_trigrams(term_grams: Column, padded: Column) -> Column:
    shared = F.size(F.filter(term_grams, lambda gram: F.contains(padded, gram)))
    return F.when(padded.isNotNull(), shared)


def trigrams(value: Column) -> Column:
    return F.array_distinct(trigram_sequence(value))


def trigram_literal(term: str) -> list[str]:
    """Trigram set of a (normalised) search term."""
    grams: dict[str, None] = {}
    word = ""
    for char in term.lower() + " ":
        if char.isalnum():
            word += char
        elif word:
            padded = f"  {word} "
            grams.update((padded[i : i + 3], None) for i in range(len(word) + 1))
            word = ""
    return list(grams)


def jaccard(left: Column, right: Column) -> Column:
    shared = F.size(F.array_intersect(left, right))
    union = F.size(left) + F.size(right) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def similarity(left: Column, right: Column) -> Column:
    return jaccard(trigrams(left), trigrams(right))


def best_run(hits: Column, wanted: Column) -> Column:
    """Best Jaccard of a run between two hit positions (ascending), in a text without repeated trigrams."""

    def best_from(start: Column, index: Column) -> Column:
        ends = F.slice(hits, index + 1, F.size(hits))
        scores = F.transform(
            ends,
            lambda end, more: (more + 1) / (wanted + (end - start + 1) - (more + 1)),
        )
        return F.array_max(scores)

    return F.array_max(F.transform(hits, best_from))


def word_similarity(term_grams: Column, sequence: Column) -> Column:
    """Best Jaccard between the term's trigrams and any contiguous run of the text's trigrams.

    The best run starts and ends on a shared trigram, so only those positions are tried. As long as
    no trigram repeats in the text, a run's shared and total counts follow from the positions.
    """
    hits = F.filter(
        F.sequence(F.lit(1), F.greatest(F.size(sequence), F.lit(1))),
        lambda i: F.array_contains(term_grams, F.get(sequence, i - 1)),
    )
    wanted = F.size(term_grams)

    def compared_from(hits: Column) -> Column:
        def best_from(start: Column) -> Column:
            ends = F.filter(hits, lambda end: end >= start)
            return F.array_max(
                F.transform(
                    ends,
                    lambda end: jaccard(
                        term_grams, F.array_distinct(F.slice(sequence, start, end - start + 1))
                    ),
                )
            )

        return F.array_max(F.transform(hits, best_from))

    # one-element array: the hits are computed once and bound to a lambda variable
    repeats = F.size(F.array_distinct(sequence)) < F.size(sequence)
    best = F.get(
        F.transform(
            F.array(hits),
            lambda h: F.when(repeats, compared_from(h)).otherwise(best_run(h, wanted)),
        ),
        F.lit(0),
    )
    return F.when(F.size(sequence) == 0, F.lit(0.0)).otherwise(F.coalesce(best, F.lit(0.0)))


def shares_enough(term_grams: Column, grams: Column, threshold: Column | float) -> Column:
    """Upper bound of the word similarity: shared trigrams over the term's trigrams."""
    return F.size(F.array_intersect(term_grams, grams)) >= threshold * F.size(term_grams)


def code_slug(value: Column) -> Column:
    """Upper-case code: other characters become single dashes, trimmed, 40 characters."""
    slug = F.regexp_replace(F.upper(value), "[^A-Z0-9-]", "-")
    slug = F.regexp_replace(F.regexp_replace(slug, "-+", "-"), "^-|-$", "")
    return F.substring(slug, 1, 40)


def is_category_code(value: Column) -> Column:
    return value.rlike(CATEGORY_CODE)
