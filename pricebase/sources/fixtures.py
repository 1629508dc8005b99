"""The TPC-H-like test tables read as documents, lines, items and links (see FIXTURES.md).

Every table is a lazy projection of the parquet files: no shuffle, no row numbering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricebase.functions.numbers import half_up
from pricebase.functions.text import search_text
from pricebase.session import configure
from pricebase.sources import dims

UNIT_CYCLE = ("m2", "ml", "m3", "u", "kg", "forfait")


def _unit_of(part_key: Column) -> Column:
    units = F.array(*[F.lit(u) for u in UNIT_CYCLE])
    return F.get(units, F.pmod(part_key, F.lit(6)).cast("int"))


def client_name(key: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in ("SCI ", "Residence ", "Copropriete ", "Cabinet ")])
    number = F.pmod(key * 7919 + 104729, F.lit(1000003)).cast("string")
    letters = F.translate(F.lpad(number, 7, "0"), "0123456789", "bactilmonr")
    return F.concat(F.get(kinds, F.pmod(key, F.lit(4)).cast("int")), letters)


class Model:
    """The model tables over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = configure(spark)
        self.dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # ---- SOURCE ---------------------------------------------------------

    def _lineitem(self) -> DataFrame:
        li = self.table("lineitem")
        k = F.col("l_orderkey") * 7 + F.col("l_partkey") * 3 + F.col("l_linenumber")
        return li.withColumn("k", k)

    @staticmethod
    def _line_id() -> Column:
        """Content key of a line, so that no global numbering is needed."""
        return F.md5(
            F.concat_ws(
                "|",
                *[F.col(c).cast("string") for c in
                  ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
                F.col("l_quantity").cast("bigint").cast("string"),
                *[F.round(F.col(c) * 100).cast("bigint").cast("string") for c in
                  ("l_extendedprice", "l_discount", "l_tax")],
                "l_returnflag",
                "l_linestatus",
                F.col("l_shipdate").cast("date").cast("string"),
            ).cast("binary")
        )

    @staticmethod
    def _line_columns() -> list[Column]:
        k = F.col("k")
        unit = (
            F.when(F.pmod(k, F.lit(10)) == 0, F.lit(None).cast("string"))
            .when(F.pmod(k, F.lit(14)) == 3, F.lit("h"))
            .when(F.pmod(k, F.lit(29)) == 5, F.lit("ens"))
            .otherwise(_unit_of(F.col("l_partkey")))
        )
        off_scope = F.pmod(k, F.lit(37)) == 0
        return [
            Model._line_id().alias("line_id"),
            F.col("l_orderkey").alias("document_id"),
            F.col("l_linenumber").alias("ord"),
            F.col("l_partkey").alias("source_item_id"),
            F.col("l_quantity").cast("decimal(14,3)").alias("quantity"),
            half_up(F.col("l_extendedprice") / F.col("l_quantity"), 4)
            .cast("decimal(14,4)")
            .alias("unit_price"),
            F.col("l_extendedprice").cast("decimal(14,2)").alias("total"),
            unit.alias("unit"),
            unit.isin("ens", "forfait").alias("is_lump_line"),
            (F.pmod(k, F.lit(31)) == 0).alias("is_title"),
            F.when(F.col("l_discount") >= 0.09, "ecart").otherwise("ok").alias("control"),
            (F.lit(1.0) - F.col("l_discount")).alias("confidence"),
            off_scope.alias("off_scope"),
            F.when(off_scope & (F.pmod(k, F.lit(2)) == 1), "llm")
            .when(off_scope, "humain:calage")
            .alias("off_scope_reason"),
            F.col("k").alias("line_key"),
        ]

    @staticmethod
    def _link_columns() -> list[Column]:
        k = F.col("k")
        validated = F.col("l_returnflag") != "N"
        return [
            F.col("l_partkey").alias("item_id"),
            ((F.pmod(k, F.lit(60)) + 40) / 100).cast("decimal(4,3)").alias("score"),
            F.when(F.pmod(k, F.lit(3)) == 0, "regle")
            .when(F.pmod(k, F.lit(3)) == 1, "llm")
            .otherwise("manuel")
            .alias("method"),
            validated.alias("validated"),
            F.when(~validated, F.lit(None).cast("string"))
            .when(F.pmod(k, F.lit(4)) == 0, "auto")
            .when(F.pmod(k, F.lit(4)) == 1, "auto-llm")
            .otherwise("calage")
            .alias("validated_by"),
            F.when(validated, F.col("l_shipdate").cast("date")).alias("validated_on"),
            (F.col("l_tax") >= 0.08).alias("excluded"),
            F.when(F.col("l_tax") >= 0.08, "aberrant").alias("exclusion_reason"),
        ]

    @staticmethod
    def _linked() -> Column:
        return F.pmod(F.col("l_partkey"), F.lit(50)) != 13

    def lines(self) -> DataFrame:
        return self._lineitem().select(*self._line_columns())

    def links(self) -> DataFrame:
        return (
            self._lineitem()
            .where(self._linked())
            .select(
                self._line_id().alias("link_id"),
                self._line_id().alias("line_id"),
                *self._link_columns(),
            )
        )

    def linked_lines(self) -> DataFrame:
        """Lines with their link in one scan (the same rows as ``lines`` joined to ``links``)."""
        return (
            self._lineitem()
            .where(self._linked())
            .select(
                *self._line_columns(), self._line_id().alias("link_id"), *self._link_columns()
            )
        )

    def worded(self, lines: DataFrame) -> DataFrame:
        """Lines plus their verbatim designation (misspellings included) and search text."""
        label = F.col("_label")
        k = F.col("line_key")
        wording = (
            F.when(F.pmod(k, F.lit(35)) == 5, F.concat(F.lit("Retenue de garantie "), label))
            .when(F.pmod(k, F.lit(35)) == 12, F.concat(F.lit("Option "), label))
            .when(F.pmod(k, F.lit(7)) == 0, F.upper(label))
            .when(F.pmod(k, F.lit(7)) == 1, F.concat(F.lit("Fourniture et pose "), label))
            .when(F.pmod(k, F.lit(7)) == 2, F.replace(label, F.lit("in"), F.lit("ni")))
            .when(F.pmod(k, F.lit(7)) == 3, F.replace(label, F.lit("e"), F.lit("é")))
            .when(F.pmod(k, F.lit(7)) == 4, F.concat(label, F.lit(" compris")))
            .otherwise(label)
        )
        labels = self.table("part").select(
            F.col("p_partkey").alias("source_item_id"), self._label().alias("_label")
        )
        return (
            lines.join(labels, "source_item_id")
            .withColumn("designation", wording)
            .withColumn("search_text", search_text(F.col("designation")))
            .drop("_label")
        )

    def documents(self, zoned: bool = True) -> DataFrame:
        """Documents; the zone costs a join to the customers, so it can be left out."""
        key = F.col("o_orderkey")
        date = F.when(F.pmod(key, F.lit(41)) == 0, F.lit(None).cast("date")).otherwise(
            F.col("o_orderdate").cast("date")
        )
        types = ("devis", "facture", "situation", "avenant", "indetermine")
        documents = self.table("orders").select(
            key.alias("document_id"),
            F.col("o_custkey").alias("customer_key"),
            date.alias("document_date"),
            (F.col("o_orderpriority") == "1-URGENT").alias("is_extra"),
            F.when(F.col("o_orderstatus") == "P", "rejete")
            .when(F.col("o_orderstatus") == "O", "a_revoir")
            .otherwise("valide")
            .alias("status"),
            F.col("o_totalprice").cast("decimal(14,2)").alias("document_total"),
            F.when(F.pmod(F.col("o_custkey"), F.lit(43)) == 0, F.lit(None).cast("bigint"))
            .otherwise(F.col("o_custkey"))
            .alias("client_id"),
            F.concat(F.lit("DEV-"), key.cast("string")).alias("number"),
            F.get(
                F.array(*[F.lit(t) for t in types]), F.pmod(key, F.lit(5)).cast("int")
            ).alias("type"),
            F.concat(F.lit("Chantier "), F.col("o_custkey").cast("string")).alias("site_title"),
            F.col("o_orderdate").cast("date").alias("created_on"),
        )
        if not zoned:
            return documents.drop("customer_key")
        places = self.customer_places()
        return documents.join(places, "customer_key", "left").drop("customer_key")

    def customer_places(self) -> DataFrame:
        # nation has 25 rows by definition of the data set
        nations = F.broadcast(
            self.table("nation").select("n_nationkey", F.col("n_regionkey").alias("zone_id"))
        )
        known = F.pmod(F.col("c_custkey"), F.lit(37)) != 0
        return self.table("customer").join(
            nations, F.col("c_nationkey") == F.col("n_nationkey"), "left"
        ).select(
            F.col("c_custkey").alias("customer_key"),
            F.when(known, F.col("zone_id")).alias("zone_id"),
            (known & (F.col("c_mktsegment") != "HOUSEHOLD")).alias("zone_reliable"),
        )

    def zones(self) -> DataFrame:
        return self.table("region").select(
            F.col("r_regionkey").alias("zone_id"),
            F.col("r_name").alias("zone_code"),
            F.concat(F.lit("Zone "), "r_name").alias("zone_label"),
            (F.col("r_regionkey") + 1).alias("zone_ord"),
        )

    def clients(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("client_id"), client_name(F.col("c_custkey")).alias("name")
        )

    def client_aliases(self) -> DataFrame:
        return self.clients().select(F.upper("name").alias("alias"), "client_id")

    def price_index(self) -> DataFrame:
        """One row per month that has orders, with gaps: bounded by the calendar."""
        months = self.table("orders").select(
            F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month")
        ).distinct()
        n = (F.year("month") - 1995) * 12 + F.month("month") - 1
        return months.where(F.pmod(n, F.lit(17)) != 5).select(
            "month", (F.lit(100) + n * 0.25).cast("decimal(10,4)").alias("coefficient")
        )

    # ---- CATALOGUE ------------------------------------------------------

    @staticmethod
    def _label() -> Column:
        return F.concat_ws(
            " ", "p_name", F.replace("p_brand", F.lit("#"), F.lit(" ")), F.lower("p_type")
        )

    def items(self) -> DataFrame:
        unit = F.when(F.col("p_size") == 50, F.lit(None).cast("string")).otherwise(
            _unit_of(F.col("p_partkey"))
        )
        return self.table("part").select(
            F.col("p_partkey").alias("item_id"),
            F.concat(F.lit("P-"), F.col("p_partkey").cast("string")).alias("code"),
            self._label().alias("label_print"),
            F.lower(self._label()).alias("label_norm"),
            unit.alias("item_unit"),
            (F.pmod(F.col("p_partkey"), F.lit(6)) == 5).alias("is_lump"),
            (F.substring("p_brand", 7, 4).cast("int") + 100).alias("category_id"),
            (F.col("p_size") != 7).alias("active"),
            F.date_add(F.lit("2020-01-01").cast("date"), F.col("p_size")).alias("created_on"),
        )

    def item_embeddings(self) -> DataFrame:
        return self.table("embeddings").select(
            F.col("vec_id").alias("item_id"), F.col("label").alias("block"), "embedding"
        )

    def catalogue_embeddings(self) -> DataFrame:
        """A vector for every item: items share the given vectors, each with a fifth of its parts stressed."""
        vectors = self.table("embeddings")
        n = vectors.agg((F.max("vec_id") + 1).alias("n")).scalar()
        items = self.items().select("item_id", F.pmod(F.col("item_id") * 7, n).alias("vec_id"))
        stressed = F.transform(
            "embedding",
            lambda x, k: x.cast("double")
            * F.when(F.pmod(F.floor(F.col("item_id") / 7) + k + 1, F.lit(5)) == 0, 1.6).otherwise(1.0),
        )
        return items.join(vectors.select("vec_id", "embedding"), "vec_id").select(
            "item_id", stressed.alias("embedding")
        )

    def categories(self) -> DataFrame:
        """One leaf per brand under five groups under one root; brand 25 has an unknown parent."""
        number = F.substring("p_brand", 7, 4).cast("int")
        leaves = self.table("part").select(number.alias("n")).distinct().select(
            (F.col("n") + 100).alias("category_id"),
            F.concat(F.lit("B"), F.col("n").cast("string")).alias("category_code"),
            F.concat(F.lit("Brand "), F.col("n").cast("string")).alias("category_label"),
            F.when(F.col("n") == 25, F.lit(99)).otherwise(F.pmod(F.col("n"), F.lit(5)) + 10)
            .cast("int").alias("parent_id"),
            F.col("n").alias("category_ord"),
        )
        top = self.spark.sql(
            "SELECT * FROM VALUES (1, 'R', 'Root', CAST(NULL AS INT), 1),"
            " (10, 'G0', 'Group 0', 1, 1), (11, 'G1', 'Group 1', 1, 2), (12, 'G2', 'Group 2', 1, 3),"
            " (13, 'G3', 'Group 3', 1, 4), (14, 'G4', 'Group 4', 1, 5)"
            " AS t(category_id, category_code, category_label, parent_id, category_ord)"
        )
        return top.unionByName(leaves)

    def units(self) -> DataFrame:
        return dims.units(self.spark)
