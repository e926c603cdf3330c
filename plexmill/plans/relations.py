"""The engine's relations over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Tables:
    """Tables of a folder as DataFrames, and the graphs built on them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def tasks(self) -> int:
        """As many as shuffles have; for work that is much more than the bytes of the files that it comes from."""
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def entities(self) -> DataFrame:
        """(id, type, name) of regions, nations, suppliers and customers."""
        part = lambda df, kind, key, name: df.select(entity_id(kind, F.col(key)).alias("id"), F.lit(kind).alias("type"), F.col(name).alias("name"))
        return (
            part(self.region, "region", "r_regionkey", "r_name")
            .unionByName(part(self.nation, "nation", "n_nationkey", "n_name"))
            .unionByName(part(self.supplier, "supplier", "s_suppkey", "s_name"))
            .unionByName(part(self.customer, "customer", "c_custkey", "c_name"))
        )

    def belongs(self) -> DataFrame:
        """belongs_to edges: supplier and customer to nation, nation to region."""

        def part(df, kind, key, to_kind, to_key):
            return df.select(entity_id(kind, F.col(key)).alias("src"), entity_id(to_kind, F.col(to_key)).alias("dst"))

        e = (
            part(self.supplier, "supplier", "s_suppkey", "nation", "s_nationkey")
            .unionByName(part(self.customer, "customer", "c_custkey", "nation", "c_nationkey"))
            .unionByName(part(self.nation, "nation", "n_nationkey", "region", "n_regionkey"))
        )
        return with_ids(e.withColumn("kind", F.lit("belongs_to")))

    def trade(self) -> DataFrame:
        """(src, tgt, calls, parts): line items between nations that differ, from supplier's to customer's."""
        supplier = self.supplier.select("s_suppkey", entity_id("nation", F.col("s_nationkey")).alias("src"))
        customer = self.customer.select("c_custkey", entity_id("nation", F.col("c_nationkey")).alias("tgt"))
        lines = (
            self.lineitem.select("l_orderkey", "l_suppkey", "l_partkey")
            .join(self.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .where("src <> tgt")
        )
        return lines.groupBy("src", "tgt").agg(F.count("*").alias("calls"), F.countDistinct("l_partkey").alias("parts"))

    def calls(self, most: int = 3) -> DataFrame:
        """calls edges: each nation's greatest trade partners."""
        w = Window.partitionBy("src").orderBy(F.desc("calls"), "tgt")
        top = self.trade().withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
        return with_ids(top.select("src", F.col("tgt").alias("dst"), F.lit("calls").alias("kind")))

    def nations(self) -> DataFrame:
        return self.entities().where("type = 'nation'")

    def items(self) -> DataFrame:
        """A catalogue: parts as items, brand as publisher, type as category, words of the name as tags."""
        return self.part.select(
            F.concat(F.lit("part:"), "p_partkey").alias("id"),
            F.col("p_name").alias("name"),
            F.col("p_type").alias("description"),
            F.array("p_type").alias("categories"),
            F.split("p_name", " ").alias("tags"),
            F.col("p_brand").alias("publisher"),
            (F.col("p_size") >= 45).alias("featured"),
            (F.col("p_size") % 5 + 1).cast("double").alias("average_rating"),
            F.col("p_size").alias("rating_count"),
            (F.col("p_partkey") % 100).alias("downloads"),
        )


def entity_id(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), key.cast("string"))


def with_ids(edges: DataFrame) -> DataFrame:
    """Edges with the id rel:<src>-><dst>:<kind>."""
    return edges.withColumn("id", F.concat(F.lit("rel:"), "src", F.lit("->"), "dst", F.lit(":"), "kind"))
