"""Changes of a table, as transforms that return its new state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.functions.text import or_else
from wayfold.sources.shared import shared_folder


def inserted(df: DataFrame, rows: DataFrame, defaults: dict[str, object] | None = None) -> DataFrame:
    """The rows added; empty or null values of the columns named become their defaults."""
    for name, value in (defaults or {}).items():
        if name in rows.columns:
            own = F.col(name)
            rows = rows.withColumn(name, or_else(own, F.lit(value)) if isinstance(value, str) else F.coalesce(own, F.lit(value)))
    return df.unionByName(rows, allowMissingColumns=True)


def patched(df: DataFrame, patches: DataFrame, key: str, columns: list[str], touched: str | None = None, now: str | None = None) -> DataFrame:
    """Rows with the patch of their key: its non-null values, and the time of change on rows that have one."""
    renamed = patches.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = df.join(renamed, key, "left")
    values = {c: F.coalesce(f"_new_{c}", c) for c in columns}
    if touched:
        values[touched] = F.when(F.col("_hit"), F.lit(now).cast(df.schema[touched].dataType)).otherwise(F.col(touched))
    return joined.withColumns(values).select(*df.columns)


def set_where(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Rows that meet the condition with new values; an unknown condition changes nothing."""
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def deleted(df: DataFrame, condition: Column) -> DataFrame:
    """The table without the rows that meet the condition; those for which it is unknown stay."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def deleted_ids(df: DataFrame, key: str, ids: DataFrame, never: object = None) -> tuple[DataFrame, DataFrame]:
    """The table without the rows of an id list, and one row with how many went; ``never`` (the caller's own) stays."""
    going = ids.select(key).distinct().where(F.col(key) != never) if never is not None else ids.select(key).distinct()
    return df.join(going, key, "left_anti"), df.join(going, key, "left_semi").agg(F.count("*").alias("deleted"))


def upserted(df: DataFrame, rows: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """New rows added or put in place of those with their key; of several new rows the last in ``order``.

    Ties go to the row with the largest values, column by column. Null keys equal nothing: such rows stay and are added. Only the
    new rows are ranked; the table itself takes part in an anti join.
    """
    values = [F.desc_nulls_last(c) for c in rows.columns if c != key] or [F.col(key)]
    latest = Window.partitionBy(key).orderBy(*([order.desc()] if order is not None else []), *values)
    one = rows.where(F.col(key).isNotNull()).withColumn("_nth", F.row_number().over(latest)).where("_nth = 1").drop("_nth")
    kept = df.join(one.select(key), key, "left_anti").select(*df.columns)
    return kept.unionByName(one, allowMissingColumns=True).unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)


def batches(df: DataFrame, order: list[Column], size: int) -> DataFrame:
    """The batch of each row in the order given, from 1.

    Rows are numbered inside ranges of the order and the ranges' sizes added up, so that no task sees all rows.
    """
    return numbered(df, order).withColumn("batch", (F.floor((F.col("nth") - 1) / size) + 1).cast("long")).drop("nth")


def settled(df: DataFrame) -> DataFrame:
    """The rows as they are now, in files that all executors share: what is read twice stays the same."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """``nth``: the row's number in the order, from 1, without a global sort in one task.

    The ranges are fixed once (their bounds are sampled, and would not be the same when planned anew), with each row's range and
    its place there; the sizes of the ranges, a row for each, are then added up.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # rows of a task count from 0
    ranged = settled(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), place.alias("_at")))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(before), "_part").withColumn("nth", F.col("_at") + F.col("_before") + 1).drop("_part", "_at", "_before")


def backfilled(df: DataFrame, source: DataFrame, column: str, on: str, value: str, condition: Column | None = None) -> DataFrame:
    """``column``, where null (and the condition holds), from the source row whose ``on`` is equal but for case; the least of several."""
    one = source.groupBy(F.lower(on).alias("_on")).agg(F.min(value).alias("_value"))
    open_ = F.col(column).isNull() if condition is None else F.col(column).isNull() & condition
    joined = df.withColumn("_key", F.lower(on)).join(one, F.col("_key") == F.col("_on"), "left")
    return joined.withColumn(column, F.when(open_, F.col("_value")).otherwise(F.col(column))).select(*df.columns)


def rewritten(df: DataFrame, source: DataFrame, key: str, column: str, value: Column, stale: Column) -> DataFrame:
    """``column`` from the source row with the same key, only on rows that are still ``stale``: a second run changes nothing.

    ``value`` is computed from the source's columns; of several source rows with a key the least value counts.
    """
    one = source.groupBy(F.col(key).alias("_key")).agg(F.min(value).alias("_value"))
    joined = df.join(one, F.col(key) == F.col("_key"), "left")
    return joined.withColumn(column, F.when(stale & F.col("_value").isNotNull(), F.col("_value")).otherwise(F.col(column))).select(*df.columns)


def logged(log: DataFrame, entries: DataFrame, key: str, now: str) -> DataFrame:
    """An audit log with new entries, numbered on from its last one in the order they have; the log's own rows never change."""
    last = log.agg(F.coalesce(F.max(key), F.lit(0)).alias("_last"))  # one row
    new = numbered(entries, [F.col(c) for c in entries.columns]).join(F.broadcast(last)).withColumn(key, F.col("_last") + F.col("nth"))
    return log.unionByName(new.withColumn("created_at", F.lit(now).cast("timestamp")).drop("_last", "nth"), allowMissingColumns=True)


def renamed_patch(body: Column, fields: dict[str, str], names: dict[str, str]) -> Column:
    """A JSON patch with the fields allowed (name and type), each under its column's name."""
    told = F.from_json(body, ", ".join(f"{k} {v}" for k, v in fields.items()))
    return F.struct(*[told[k].alias(names.get(k, k)) for k in fields])


def set_where_exists(df: DataFrame, other: DataFrame, key: str, column: str, value: Column) -> DataFrame:
    """``column`` set on rows whose key the other table has."""
    known = other.select(F.col(key)).where(F.col(key).isNotNull()).distinct().withColumn("_hit", F.lit(True))
    return df.join(known, key, "left").withColumn(column, F.when(F.col("_hit"), value).otherwise(F.col(column))).select(*df.columns)


def references_cleared(df: DataFrame, column: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """References to rows that are gone set to null."""
    known = parents.select(F.col(parent_key).alias("_parent")).distinct()
    return df.join(known, F.col(column) == F.col("_parent"), "left").withColumn(column, F.col("_parent").cast(df.schema[column].dataType)).select(*df.columns)


def still_referenced(parents: DataFrame, parent_key: str, children: DataFrame, column: str) -> DataFrame:
    """Parents that may not be deleted: children refer to them."""
    return parents.join(children.select(F.col(column).alias(parent_key)), parent_key, "left_semi")


def widened(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """New nullable columns."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def placeholder(df: DataFrame, name: str, fallback: str, state: str) -> DataFrame:
    """Entities for rows without one: a name, else the fallback with the key, and an address that holds the state only."""
    own = or_else(F.col(name), F.concat(F.lit(fallback), F.col("id").cast("string")))
    return df.withColumn("entity_name", own).withColumn("entity_address", F.concat(F.lit(", "), F.col(state)))


def assignment(body: Column) -> Column:
    """A patch of who takes a case: empty means null, and what is done is named after the ids that are there."""
    clinic, firm = F.nullif(body["clinic_id"], F.lit("")), F.nullif(body["lawyer_id"], F.lit(""))
    action = F.when(clinic.isNotNull() & firm.isNotNull(), "assigned_both").when(clinic.isNotNull(), "assigned_clinic").when(firm.isNotNull(), "assigned_lawyer").otherwise("updated")
    return F.struct(clinic.alias("clinic_id"), firm.alias("lawyer_id"), action.alias("action"))
