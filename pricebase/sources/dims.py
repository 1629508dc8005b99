"""Reference dimensions of fixed size, as inline tables (their size is known to the planner)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Price zones (code, label, order).
ZONES = (
    ("06", "Alpes-Maritimes", 1),
    ("MERCANTOUR", "Mercantour", 2),
    ("TOULON", "Toulon et alentours", 3),
    ("83_AUTRE", "Reste du Var", 4),
)
# Towns of each zone (postal code, town, zone code).
ZONE_TOWNS = (
    ("06000", "Nice", "06"), ("06100", "Nice", "06"), ("06200", "Nice", "06"),
    ("06300", "Nice", "06"), ("06400", "Cannes", "06"), ("06600", "Antibes", "06"),
    ("06130", "Grasse", "06"), ("06800", "Cagnes-sur-Mer", "06"),
    ("06500", "Menton", "06"), ("06220", "Vallauris", "06"),
    ("06210", "Mandelieu-la-Napoule", "06"), ("06110", "Le Cannet", "06"),
    ("06250", "Mougins", "06"), ("06700", "Saint-Laurent-du-Var", "06"),
    ("06140", "Vence", "06"), ("06270", "Villeneuve-Loubet", "06"),
    ("06160", "Antibes Juan-les-Pins", "06"),
    ("06450", "Saint-Martin-Vésubie", "MERCANTOUR"), ("06450", "Roquebillière", "MERCANTOUR"),
    ("06450", "Belvédère", "MERCANTOUR"), ("06420", "Isola", "MERCANTOUR"),
    ("06420", "Valdeblore", "MERCANTOUR"), ("06660", "Saint-Étienne-de-Tinée", "MERCANTOUR"),
    ("06470", "Guillaumes", "MERCANTOUR"), ("06470", "Beuil", "MERCANTOUR"),
    ("06470", "Péone", "MERCANTOUR"), ("06430", "Tende", "MERCANTOUR"),
    ("83000", "Toulon", "TOULON"), ("83100", "Toulon", "TOULON"), ("83200", "Toulon", "TOULON"),
    ("83500", "La Seyne-sur-Mer", "TOULON"), ("83130", "La Garde", "TOULON"),
    ("83160", "La Valette-du-Var", "TOULON"), ("83140", "Six-Fours-les-Plages", "TOULON"),
    ("83190", "Ollioules", "TOULON"), ("83220", "Le Pradet", "TOULON"),
    ("83400", "Hyères", "TOULON"), ("83110", "Sanary-sur-Mer", "TOULON"),
    ("83600", "Fréjus", "83_AUTRE"), ("83700", "Saint-Raphaël", "83_AUTRE"),
    ("83300", "Draguignan", "83_AUTRE"), ("83170", "Brignoles", "83_AUTRE"),
    ("83340", "Le Luc", "83_AUTRE"), ("83120", "Sainte-Maxime", "83_AUTRE"),
    ("83990", "Saint-Tropez", "83_AUTRE"), ("83520", "Roquebrune-sur-Argens", "83_AUTRE"),
    ("83480", "Puget-sur-Argens", "83_AUTRE"), ("83550", "Vidauban", "83_AUTRE"),
)
# Department prefix used when the postal code itself is unknown.
DEPARTMENT_ZONES = {"06": "06", "83": "83_AUTRE"}
# Units (code, label, is_lump, aggregable).
UNITS = (
    ("m2", "mètre carré", False, True),
    ("ml", "mètre linéaire", False, True),
    ("m3", "mètre cube", False, True),
    ("u", "unité", False, True),
    ("kg", "kilogramme", False, True),
    ("h", "heure", False, True),
    ("j", "jour", False, True),
    ("ens", "ensemble", True, False),
    ("forfait", "forfait", True, False),
)
# Printed labels of the units.
UNIT_LABELS = {
    "m2": "m²", "ml": "ml", "m3": "m³", "u": "u", "kg": "kg",
    "h": "h", "j": "j", "ens": "ens", "forfait": "forfait",
}
# Unit spellings (alias, unit, factor).
UNIT_ALIASES = (
    ("m2", "m2", 1), ("M2", "m2", 1), ("m²", "m2", 1), ("M²", "m2", 1),
    ("mètre carré", "m2", 1), ("cm2", "m2", 0.0001),
    ("ml", "ml", 1), ("ML", "ml", 1), ("Ml", "ml", 1), ("mètre linéaire", "ml", 1),
    ("m", "ml", 1), ("M", "ml", 1),
    ("m3", "m3", 1), ("M3", "m3", 1), ("m³", "m3", 1),
    ("u", "u", 1), ("U", "u", 1), ("un", "u", 1), ("unité", "u", 1), ("Unité", "u", 1),
    ("pce", "u", 1), ("p", "u", 1),
    ("kg", "kg", 1), ("Kg", "kg", 1), ("KG", "kg", 1), ("t", "kg", 1000),
    ("h", "h", 1), ("H", "h", 1), ("hr", "h", 1),
    ("j", "j", 1), ("J", "j", 1), ("jour", "j", 1),
    ("ens", "ens", 1), ("Ens", "ens", 1), ("ENS", "ens", 1), ("ens.", "ens", 1),
    ("ensemble", "ens", 1), ("e", "ens", 1), ("E", "ens", 1),
    ("fft", "forfait", 1), ("Fft", "forfait", 1), ("ft", "forfait", 1),
    ("forfait", "forfait", 1), ("Forfait", "forfait", 1), ("FORFAIT", "forfait", 1),
    ("for", "forfait", 1), ("fo", "forfait", 1), ("F", "forfait", 1),
)
# Categories (code, label, parent code, order).
CATEGORIES = (
    ("GO", "Gros œuvre", None, 1),
    ("GO.BA", "Béton armé", "GO", 1),
    ("GO.MA", "Maçonnerie", "GO", 2),
    ("CM", "Charpente métallique", None, 2),
    ("ET", "Étanchéité", None, 3),
    ("RA", "Ravalement et façade", None, 4),
    ("DE", "Démolition", None, 5),
    ("FC", "Frais de chantier", None, 6),
    ("EL", "Électricité", None, 7),
    ("PL", "Plomberie et CVC", None, 8),
    ("ME", "Menuiserie", None, 9),
    ("PE", "Peinture et finitions", None, 10),
    ("VR", "VRD et réseaux", None, 11),
    ("SO", "Second œuvre divers", None, 12),
)


def _sql(value: object) -> str:
    if value is None:
        return "CAST(NULL AS STRING)"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def _inline(spark: SparkSession, rows: tuple, columns: str) -> DataFrame:
    body = ", ".join("(" + ", ".join(_sql(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({columns})")


def zones(spark: SparkSession) -> DataFrame:
    rows = tuple((i + 1, *zone) for i, zone in enumerate(ZONES))
    return _inline(spark, rows, "zone_id, code, label, ord")


def zone_towns(spark: SparkSession) -> DataFrame:
    return _inline(spark, ZONE_TOWNS, "postal_code, town, zone_code")


def units(spark: SparkSession) -> DataFrame:
    return _inline(spark, UNITS, "code, label, is_lump, aggregable")


def unit_aliases(spark: SparkSession) -> DataFrame:
    rows = tuple((a, u, float(f)) for a, u, f in UNIT_ALIASES)
    return _inline(spark, rows, "alias, code, factor").selectExpr(
        "alias", "code", "cast(factor as decimal(12,6)) factor"
    )


def categories(spark: SparkSession) -> DataFrame:
    ids = {code: i + 1 for i, (code, *_) in enumerate(CATEGORIES)}
    rows = tuple((ids[c], c, label, ids.get(parent, 0), o) for c, label, parent, o in CATEGORIES)
    return _inline(spark, rows, "category_id, code, label, parent_id, ord").selectExpr(
        "category_id", "code", "label", "nullif(parent_id, 0) parent_id", "ord"
    )


def neutral_index(spark: SparkSession) -> DataFrame:
    """Index used until a real one is loaded: a single month at 1."""
    return spark.sql("SELECT DATE'2024-01-01' AS month, CAST(1 AS DECIMAL(10,4)) AS coefficient")
