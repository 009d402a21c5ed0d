"""Referrals: counts by status, completion, months, leaders, visibility, recipients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.functions.text import present
from wayfold.operators.mutate import numbered

#: Up to so many rows a page is cut from a sorted top; deeper pages from numbered ranges.
SHALLOW = 10_000


def percent(part: Column, whole: Column) -> Column:
    """A rounded percentage, 0 of nothing."""
    return F.when(whole > 0, F.floor(part / whole * 100 + 0.5)).otherwise(F.lit(0)).cast("long")


def status_counts(df: DataFrame, status: str, names: dict[str, str], done: str) -> DataFrame:
    """One row, one pass: the total, a count for each status under its name, and the completion rate."""
    counts = df.agg(F.count("*").alias("total"), *[F.count_if(F.col(status) == value).alias(name) for value, name in names.items()])
    return counts.withColumn("completion", percent(F.col(done), F.col("total")))


def breakdown(df: DataFrame, status: str, domain: dict[str, str]) -> DataFrame:
    """A row for each status of the domain in its order, also those that no row has."""
    spark = df.sparkSession
    known = spark.range(1).select(F.posexplode(F.array(*[F.struct(F.lit(k).alias("status"), F.lit(v).alias("label")) for k, v in domain.items()])).alias("place", "s")).select("place", "s.*")
    counted = df.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))
    return known.join(counted, "status", "left").select("place", "label", F.coalesce("n", F.lit(0)).alias("value"))


def last_months(df: DataFrame, ts: str, now: str, months: int = 6) -> DataFrame:
    """Counts of the last calendar months up to that of ``now``, also empty ones, with short labels."""
    spark, this = df.sparkSession, F.trunc(F.lit(now).cast("date"), "MM")
    first = F.add_months(this, 1 - months)
    wanted = spark.range(1).select(F.explode(F.sequence(first, this, F.expr("interval 1 month"))).alias("month"))
    rows = df.where((F.col(ts) >= first) & (F.col(ts) < F.add_months(this, 1)))  # pushed down to the scan
    counted = rows.groupBy(F.trunc(F.col(ts).cast("date"), "MM").alias("month")).agg(F.count("*").alias("n"))
    return wanted.join(counted, "month", "left").select("month", F.date_format("month", "MMM").alias("label"), F.coalesce("n", F.lit(0)).alias("value"))


def leaders(df: DataFrame, name: str, most: int = 5) -> DataFrame:
    """The names that occur most often; ties by name, missing names left out."""
    return df.where(present(F.col(name)).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(most)


def recent(df: DataFrame, ts: str, key: str, most: int = 5) -> DataFrame:
    """The newest rows; ties by key."""
    return df.orderBy(F.desc(ts), key).limit(most)


def visible_to(df: DataFrame, role: str, clinic_id: object = None, firm_id: object = None, user_id: object = None) -> DataFrame:
    """The rows a role may see: all for admins, a firm's or a clinic's own, a referrer's or partner's own where rows name one, none for others."""
    if role == "admin":
        return df
    if role == "lawyer" and firm_id is not None:
        return df.where(F.col("lawyer_id") == firm_id)
    if role == "clinic" and clinic_id is not None:
        return df.where((F.col("clinic_id") == clinic_id) | (F.col("target_clinic_id") == clinic_id))
    if role in ("referrer", "partner") and user_id is not None and "referrer_id" in df.columns:
        return df.where(F.col("referrer_id") == user_id)
    return df.where(F.lit(False))


def secured(df: DataFrame, policies: dict[str, Column], role: str, view: str) -> DataFrame:
    """A temporary view with the rows that the role's policy lets through; a role without a policy sees none."""
    seen = df.where(F.coalesce(policies.get(role, F.lit(False)), F.lit(False)))
    seen.createOrReplaceTempView(view)
    return df.sparkSession.table(view)


def with_lookups(df: DataFrame, lookups: dict[str, tuple[DataFrame, str, dict[str, str], str]]) -> DataFrame:
    """New rows with columns of the entities they name, and ``error``: the message of the first reference that leads nowhere.

    ``lookups``: the referring column, then the entities, their key, columns under new names, and the message. A null reference
    is no error. Of entities with the same key the least row counts.
    """
    out, error = df, F.lit(None).cast("string")
    for at, (column, (entities, key, names, message)) in enumerate(lookups.items()):
        one = entities.groupBy(F.col(key).alias(f"_key{at}")).agg(F.min(F.struct(*[F.col(c).alias(n) for c, n in names.items()])).alias(f"_found{at}"))
        out = out.join(one, F.col(column) == F.col(f"_key{at}"), "left")
        error = F.coalesce(error, F.when(F.col(column).isNotNull() & F.col(f"_key{at}").isNull(), message))
    found = [F.col(f"_found{at}.{n}").alias(n) for at, (_, _, names, _) in enumerate(lookups.values()) for n in names.values()]
    return out.select(*df.columns, *found, error.alias("error"))


def variant(kind: Column, cases: dict[str, dict[str, Column]]) -> list[Column]:
    """Columns that each kind of row takes from elsewhere; null for other kinds and for what a kind lacks."""
    names = list(dict.fromkeys(n for fields in cases.values() for n in fields))
    chosen = []
    for n in names:
        value = F.lit(None)
        for k, fields in cases.items():
            if n in fields:
                value = F.when(kind == k, fields[n]).otherwise(value)
        chosen.append(value.alias(n))
    return chosen


def may_edit(role: Column, clinic_id: Column, firm_id: Column) -> Column:
    """Admins may; so may the firm and the clinics that a referral names."""
    own = ((role == "lawyer") & (F.col("lawyer_id") == firm_id)) | ((role == "clinic") & ((F.col("clinic_id") == clinic_id) | (F.col("target_clinic_id") == clinic_id)))
    return (role == "admin") | F.coalesce(own, F.lit(False))


def recipients(entities: DataFrame, users: DataFrame, link: str) -> DataFrame:
    """Whom to notify about each entity: its own address and those of its users, once each, no blanks."""
    own = entities.select("id", "email")
    theirs = entities.select("id").join(users.select(F.col(link).alias("id"), F.col("email")), "id")
    return own.unionByName(theirs).where(present(F.col("email")).isNotNull()).distinct()


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page in the order given, with its row numbers, the total of rows and that of pages."""
    size, number = max(size, 1), max(number, 1)
    total = df.agg(F.count("*").alias("total"))
    if number * size <= SHALLOW:  # only the pages up to this one are sorted in full: a top-k, not a global window
        rows = df.orderBy(*order).limit(number * size).withColumn("nth", F.row_number().over(Window.orderBy(*order)).cast("long"))
    else:
        rows = numbered(df, order)
    rows = rows.where((F.col("nth") > (number - 1) * size) & (F.col("nth") <= number * size)).select(*df.columns, "nth")
    return rows.join(F.broadcast(total)).withColumn("pages", F.ceil(F.col("total") / size).cast("long"))


def settings_object(df: DataFrame, key: str, value: str) -> DataFrame:
    """Key/value rows as one row with a map."""
    return df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias("settings"))
