"""The driver's tables seen as structures, measurements, vectors and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..store import keep

LETTERS = "ACDEFGHIKLMNPQRSTVWY"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as atoms: a supplier is a complex, the line status its side."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(F.col("l_suppkey").alias("complex"), F.when(F.col("l_linestatus") == "F", 1).otherwise(2).alias("side"), F.col("l_returnflag").alias("type"), F.col("l_quantity").alias("x"), F.round(F.col("l_discount") * 100).alias("y"), F.round(F.col("l_tax") * 100).alias("z"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_extendedprice").alias("price"))


ATOMS = "atom AS (SELECT l_suppkey AS complex, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS side, l_returnflag AS type, l_quantity AS x, round(l_discount * 100) AS y, round(l_tax * 100) AS z, l_orderkey AS o, l_linenumber AS line, l_partkey AS part, l_extendedprice AS price FROM lineitem)"
_D = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"
PAIRS = f"{ATOMS}, pair AS (SELECT * FROM (SELECT a.complex, a.o AS o_a, b.o AS o_b, a.type AS t_a, b.type AS t_b, least(a.type, b.type) AS type_a, greatest(a.type, b.type) AS type_b, {_D} AS d FROM atom a JOIN atom b ON a.complex = b.complex AND a.side = 1 AND b.side = 2))"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atoms(spark, sf_dir).select("complex", "side", F.when(F.col("type") == "R", "H").otherwise(F.col("type")).alias("type"), "x", "y", "z")


def numbered(spark: SparkSession, sf_dir: str, **more: Column) -> DataFrame:
    """Distinct atoms with their place `n` in their complex, from 1, and columns of their
    own; one shuffle does both."""
    one = _named(spark, sf_dir).repartition("complex").distinct().withColumns(more)
    return one.withColumn("n", F.row_number().over(Window.partitionBy("complex").orderBy("side", "type", "x", "y", "z")))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct atoms with a name and a number of their own, and R atoms called hydrogen."""
    a = _named(spark, sf_dir).distinct()
    code = F.col("side") * 128 + F.ascii("type")
    for c in "xyz":
        code = code * 64 + F.col(c).cast("long")
    # Written once: an operator reads its points several times.
    return keep(a.withColumns({"serial": F.concat_ws("/", "side", "type", *[F.col(c).cast("int") for c in "xyz"]), "code": code}))


PLACES = f"{ATOMS}, place AS (SELECT *, concat_ws('/', side, type, x::int, y::int, z::int) AS serial FROM (SELECT DISTINCT complex, side, CASE WHEN type = 'R' THEN 'H' ELSE type END AS type, x, y, z FROM atom))"


def near(a: str, b: str) -> str:
    return f"sqrt(({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y) + ({a}.z - {b}.z) * ({a}.z - {b}.z))"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    return t.select(F.col("l_quantity").alias("observed"), F.col("l_extendedprice").alias("predicted"), F.col("l_suppkey").alias("cluster"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("response"))


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as measurements; a priority is a type, a status a kind of structure."""
    t = table(spark, sf_dir, "orders")
    kind = F.create_map(*map(F.lit, ("1-URGENT", "KD", "2-HIGH", "KI", "3-MEDIUM", "IC50", "4-NOT SPECIFIED", "SCORE")))[F.col("o_orderpriority")]
    return t.select(F.col("o_orderkey").alias("accession"), F.coalesce(kind, F.lit("KD")).alias("affinity_type"), F.lit("=").alias("affinity_match"), F.col("o_totalprice").alias("raw"), F.when(F.col("o_orderstatus") == "F", "XRAY").otherwise("NMR").alias("structure_type"), F.year("o_orderdate").alias("year"), F.col("o_custkey").alias("customer"))


MEASURED = "measured AS (SELECT o_orderkey AS accession, CASE o_orderpriority WHEN '2-HIGH' THEN 'KI' WHEN '3-MEDIUM' THEN 'IC50' WHEN '4-NOT SPECIFIED' THEN 'SCORE' ELSE 'KD' END AS affinity_type, o_totalprice AS raw, CASE WHEN o_orderstatus = 'F' THEN 'XRAY' ELSE 'NMR' END AS structure_type, year(o_orderdate) AS year, o_custkey AS customer FROM orders), valued AS (SELECT *, CASE WHEN affinity_type = 'SCORE' THEN raw ELSE ln(raw) END AS value FROM measured)"


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors clustered by label, and again by the parity of the label."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("complex_id"), "label")
    fine = v.select(F.lit(0).alias("clustering_id"), F.lit(0.5).alias("min_dist"), F.col("label").alias("cluster_id"), "complex_id")
    return fine.unionByName(v.select(F.lit(1).alias("clustering_id"), F.lit(1.5).alias("min_dist"), (F.col("label") % 2).alias("cluster_id"), "complex_id"))


MEMBERS = "member AS (SELECT 0 AS clustering_id, 0.5::double AS min_dist, label AS cluster_id, vec_id AS complex_id FROM embeddings UNION ALL SELECT 1, 1.5::double, label % 2, vec_id FROM embeddings)"


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as proteins: upper case, only letters of the twenty residues."""
    t = table(spark, sf_dir, "benchmark")
    return t.select("item_id", F.regexp_replace(F.translate("text", LETTERS.lower(), LETTERS), f"[^{LETTERS}]", "").alias("sequence"))


SEQUENCES = f"seq AS (SELECT item_id, regexp_replace(translate(text, '{LETTERS.lower()}', '{LETTERS}'), '[^{LETTERS}]', '', 'g') AS sequence FROM benchmark)"
