"""The driver's tables seen as a referral network, in Spark and in SQL.

Referrals are orders, firms are customers, clinics are suppliers, activity is events. What these tables lack is derived from
their keys by the same arithmetic on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.sources import tables


def table(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    return tables.read(spark, d, name, list(columns) or None)


def place_columns(key: str, name: str) -> dict[str, Column]:
    k = F.col(key)
    state = F.when(k % 2 == 0, "FL").otherwise("MN")
    return {
        "id": k, "name": F.col(name), "lat": 25 + (k % 600).cast("double") / 100, "lng": -87 + (k % 700).cast("double") / 100,
        "address": F.concat((k % 97).cast("string"), F.lit(" Main St, CITY"), (k % 25).cast("string"), F.lit(", "), state, F.lit(" "), F.lpad((k % 100000).cast("string"), 5, "0")),
        "email": F.concat(F.lit("u"), k.cast("string"), F.lit("@Dom"), (k % 40).cast("string"), F.lit(".example.com")),
        "phone": F.when(k % 11 == 0, "n/a").otherwise(F.concat(F.lit("+1 (555) "), F.lpad((k % 10000).cast("string"), 4, "0"))),
    }


def place_sql(key: str, name: str) -> str:
    return f"""{key} AS id, {name} AS name, 25 + CAST({key} % 600 AS DOUBLE) / 100 AS lat, -87 + CAST({key} % 700 AS DOUBLE) / 100 AS lng,
        concat({key} % 97, ' Main St, CITY', {key} % 25, ', ', CASE WHEN {key} % 2 = 0 THEN 'FL' ELSE 'MN' END, ' ', lpad(CAST({key} % 100000 AS VARCHAR), 5, '0')) AS address,
        concat('u', {key}, '@Dom', {key} % 40, '.example.com') AS email,
        CASE WHEN {key} % 11 = 0 THEN 'n/a' ELSE concat('+1 (555) ', lpad(CAST({key} % 10000 AS VARCHAR), 4, '0')) END AS phone"""


def clinics(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # fixed tables of 25 and 5 rows
    rows = table(spark, d, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(*[c.alias(n) for n, c in place_columns("s_suppkey", "s_name").items()], F.col("n_name").alias("county"), F.col("r_name").alias("region"), (F.col("s_acctbal") >= 0).alias("available"))


CLINICS = f"clinics AS (SELECT {place_sql('s_suppkey', 's_name')}, n_name AS county, r_name AS region, s_acctbal >= 0 AS available FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def tagged_clinics(spark: SparkSession, d: str) -> DataFrame:
    offered = table(spark, d, "part", "p_partkey", "p_type").select((F.col("p_partkey") % 997).alias("id"), "p_type")
    tags = offered.groupBy("id").agg(F.array_sort(F.collect_set("p_type")).alias("specialties"))
    return clinics(spark, d).join(tags, "id", "left")


TAGGED = CLINICS + ", tags AS (SELECT p_partkey % 997 AS id, list_sort(list(DISTINCT p_type)) AS specialties FROM part GROUP BY 1), tagged AS (SELECT clinics.*, specialties FROM clinics LEFT JOIN tags USING (id))"


def firms(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(*[c.alias(n) for n, c in place_columns("c_custkey", "c_name").items()], F.array("c_mktsegment").alias("practice_areas"), F.col("n_name").alias("county"), F.col("r_name").alias("region"))


FIRMS = f"firms AS (SELECT {place_sql('c_custkey', 'c_name')}, [c_mktsegment] AS practice_areas, n_name AS county, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def referrals(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        k.alias("id"), F.when(F.col("o_custkey") % 97 != 0, F.col("o_custkey")).alias("lawyer_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"),
        F.col("o_orderpriority").alias("case_type"), (k % 100).alias("clinic_id"), (k % 37).alias("target_clinic_id"), F.col("o_totalprice").alias("amount"),
    )


REFERRALS = "referrals AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 97 <> 0 THEN o_custkey END AS lawyer_id, o_orderstatus AS status, o_orderdate AS created_at, o_orderpriority AS case_type, o_orderkey % 100 AS clinic_id, o_orderkey % 37 AS target_clinic_id, o_totalprice AS amount FROM orders)"


def users(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k.alias("id"), F.when(k % 5 != 0, k).alias("lawyer_id"), (k % 100).alias("clinic_id"), F.when(k % 2 == 0, "lawyer").otherwise("clinic").alias("role"),
        F.concat(F.lit("U"), k.cast("string"), F.lit("@dom"), (k % 40).cast("string"), F.lit(".example.com")).alias("email"), F.when(k % 2 == 0, "FL").otherwise("MN").alias("state"),
        F.concat(F.lit("Law Group "), F.col("c_mktsegment")).alias("firm_name"),
    )


USERS = """users AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey END AS lawyer_id, c_custkey % 100 AS clinic_id, CASE WHEN c_custkey % 2 = 0 THEN 'lawyer' ELSE 'clinic' END AS role,
    concat('U', c_custkey, '@dom', c_custkey % 40, '.example.com') AS email, CASE WHEN c_custkey % 2 = 0 THEN 'FL' ELSE 'MN' END AS state, concat('Law Group ', c_mktsegment) AS firm_name FROM customer)"""
