"""The store's tables: their schemas, reads with explicit columns, and names in the other style."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SCHEMAS = {
    "users": "id string, username string, name string, role string, clinic_id string, lawyer_id string, firm_name string, email string, state string, created_at timestamp, updated_at timestamp",
    "clinics": "id string, name string, address string, lat double, lng double, phone string, specialties array<string>, email string, website string, region string, county string, available boolean, created_at timestamp, updated_at timestamp",
    "lawyers": "id string, name string, address string, lat double, lng double, phone string, practice_areas array<string>, email string, website string, region string, county string, zip_code string, available boolean, created_at timestamp, updated_at timestamp",
    "contacts": "id int, name string, email string, phone string, service string, message string, created_at timestamp",
    "newsletter_subscribers": "id int, email string, subscribed_at timestamp",
    "activity_logs": "id long, user_id string, user_name string, action string, target_type string, target_id string, target_name string, details string, created_at timestamp",
    "settings": "key string, value string, updated_at timestamp, updated_by string",
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[table])


def read(spark: SparkSession, folder: str, table: str, columns: list[str] | None = None) -> DataFrame:
    """A table of the folder; with a column list, only those columns are read."""
    df = spark.read.parquet(f"{folder}/{table}.parquet")
    return df.select(*columns) if columns else df
