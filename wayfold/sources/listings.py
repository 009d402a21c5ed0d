"""Listings as people keep them: CSV with stray rows, JSON documents, Markdown lists. Missing files give empty frames."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.functions import address as addresses
from wayfold.functions.text import matching_form, or_else, padded_id, present, starts_with_pictograph, trimmed
from wayfold.operators.mutate import numbered
from wayfold.sources import ranges


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The columns by header name (trimmed, a byte order mark dropped), values trimmed, blank rows and rows that are too short left out.

    ``columns`` are all columns of the file, in any order. Rows with more fields than the header keep those they should have. A
    quoted value may hold commas, line breaks and doubled quotes. The file is read by ranges (``ranges.quoted_records``), a folder as the
    parts of one file.
    """
    return _csv_rows(spark, path, columns).select(*columns)


def _csv_rows(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The columns, and the number of the record."""
    options = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "maxCharsPerColumn": "-1"}
    fields = [n.strip().strip('" ') for n in ranges.first_line(spark, path).removeprefix("\ufeff").split(",")]
    missing = [c for c in columns if c not in fields]
    if missing:
        raise ValueError(f"{path} lacks {missing}")
    records = ranges.quoted_records(ranges.lines_of(spark, path)).where("record > 0").withColumn("text", F.regexp_replace("text", r"\r$", ""))
    held = F.regexp_count(F.regexp_replace("text", '"[^"]*"', ""), F.lit(",")) + 1
    schema = ", ".join(f"f{i} string" for i in range(len(fields)))
    told = records.where((trimmed(F.col("text")) != "") & (held >= len(fields))).select("record", F.from_csv("text", F.lit(schema), options | {"multiLine": "true", "mode": "PERMISSIVE"}).alias("row"))
    return told.select(*[trimmed(F.coalesce(F.col(f"row.f{fields.index(c)}"), F.lit(""))).alias(c) for c in columns], "record")


def read_csv_files(spark: SparkSession, files: dict[str, str], columns: list[str], category: str) -> DataFrame:
    """Several files in one frame, each with its category and its place among the files; missing files are skipped."""
    frames = []
    for place, (name, path) in enumerate(files.items()):
        try:
            frames.append(_csv_rows(spark, path, columns).withColumnRenamed("record", "line").withColumns({category: F.lit(name), "file": F.lit(place)}))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    if not frames:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in [*columns, category]) + ", file int, line long")
    return reduce(DataFrame.unionByName, frames)


def is_section_row(name: Column, address: Column, county: Column) -> Column:
    """Headings inside a listing: no name, no address, or a pictograph or dash in the county."""
    return present(name).isNull() | present(address).isNull() | starts_with_pictograph(county) | county.contains("—")


def picked_field(df: DataFrame, *names: str) -> Column:
    """The first non-empty of several spellings of a column that the frame has."""
    held = [F.col(f"`{c}`") for n in names for c in df.columns if c.strip() == n]
    return or_else(*held, "") if held else F.lit("")


def merged_firms(rows: DataFrame, state: str, area: str = "area") -> DataFrame:
    """A row for each firm (same name and address but for case and punctuation) with all its areas; first values win."""
    placed = rows.withColumn("full_address", addresses.joined([F.col("address")], state, F.col("zip")))
    order = F.struct("file", "line")
    keyed = placed.withColumns({"_name": matching_form(F.col("name")), "_address": matching_form(F.col("full_address"))})
    first = {c: F.min_by(c, order).alias(c) for c in ("name", "full_address", "phone", "county", "region", "zip")}
    return keyed.groupBy("_name", "_address").agg(*first.values(), F.array_sort(F.collect_set(area)).alias("areas"), F.min(order).alias("order")).drop("_name", "_address")


def with_ids(df: DataFrame, prefix: str, order: list[Column], after: int = 0) -> DataFrame:
    """``id``: the prefix and the place in the order, behind those given so far."""
    return numbered(df, order).withColumn("id", padded_id(F.col("nth") + after, prefix)).drop("nth")


def tallies(rows: DataFrame, key: list[str], file: str) -> DataFrame:
    """For each file the rows read, and those whose key no earlier row has."""
    order = Window.partitionBy(*key).orderBy("file", "line")
    return rows.withColumn("_new", F.row_number().over(order) == 1).groupBy(file).agg(F.count("*").alias("rows"), F.count_if("_new").alias("new"))


def read_json_records(spark: SparkSession, path: str, schema: str, inside: str | None = "records") -> DataFrame:
    """The records of a JSON document's array, or of a file that is one array."""
    if inside is None:
        return spark.read.schema(schema).json(path, multiLine=True)
    return spark.read.schema(f"{inside} array<struct<{schema}>>").json(path, multiLine=True).select(F.inline(inside))


def read_markdown(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Clinics of a Markdown list: region and county lines hold for what follows, a numbered line opens a record, and lines
    marked by a pin, a telephone or a globe belong to it. Records without an address are left out.

    Lists are read by ranges. Each file is a list of its own; if ``whole``, all files of a folder are the parts of one list.
    """
    return parsed_markdown(ranges.lines_of(spark, path, whole)).drop("file")


def parsed_markdown(lines: DataFrame) -> DataFrame:
    """As ``read_markdown``, from the lines of lists (file, range, at, text)."""
    text = trimmed(F.col("text"))
    region = F.when(text.rlike(r"^(# |[\x{1F7E5}-\x{1F7EB}])"), trimmed(F.regexp_replace(text, r"^[#\s\x{1F7E5}-\x{1F7EB}\x{FE0F}]+", "")))
    county = F.when(text.rlike(r"^##+ "), trimmed(F.regexp_replace(text, r"^#+\s*", "")))
    name = F.when(text.rlike(r"^\**[0-9]+[.)]\s*"), trimmed(F.regexp_replace(text, r"^\**[0-9]+[.)]\s*|\*+$", "")))
    marked = lambda mark: F.when(text.rlike(mark), trimmed(F.regexp_replace(text, f"^[-*\\s]*{mark}\\s*", "")))
    told = lines.select("file", "range", "at", region.alias("r"), county.alias("c"), name.alias("n"), marked(r"\x{1F4CD}").alias("a"), marked(r"\x{1F4DE}").alias("p"), marked(r"\x{1F310}").alias("w"))
    # a county line ends the record above it; a region line the county too
    held = ranges.carried(told, {"region": F.col("r"), "county": F.when(F.col("r").isNotNull(), F.lit("")).otherwise(F.col("c"))}, {"record": F.col("n").isNotNull()})
    place = F.struct("range", "at")
    one = held.where("record > 0").groupBy("file", "record").agg(
        F.min_by("n", F.when(F.col("n").isNotNull(), place)).alias("name"), F.array_compact(F.transform(F.array_sort(F.collect_list(F.when(F.col("a").isNotNull(), F.struct("range", "at", "a")))), lambda x: x.a)).alias("addresses"),
        F.min_by("p", F.when(F.col("p").isNotNull(), place)).alias("phone"), F.min_by("w", F.when(F.col("w").isNotNull(), place)).alias("website"),
        F.min_by("region", place).alias("region"), F.nullif(F.min_by("county", place), F.lit("")).alias("county"),
    )
    return one.where(F.size("addresses") > 0)


def located(df: DataFrame, cache: DataFrame, address: str = "address") -> DataFrame:
    """Coordinates from a table of known places (place, lat, lng): of the address, else of what follows its first comma.

    Of several rows with one place the one farthest south counts.
    """
    known = cache.where("lat IS NOT NULL").groupBy("place").agg(F.min(F.struct("lat", "lng")).alias("at")).select("place", "at.*")
    exact = known.select(F.col("place").alias(address), F.col("lat").alias("_lat"), F.col("lng").alias("_lng"))
    town = known.select(F.col("place").alias("_town"), F.col("lat").alias("_tlat"), F.col("lng").alias("_tlng"))
    tail = df.withColumn("_town", trimmed(F.regexp_extract(address, r"^[^,]*,(.*)$", 1)))
    joined = tail.join(exact, address, "left").join(town, "_town", "left")
    return joined.withColumns({"lat": F.coalesce("_lat", "_tlat", F.lit(0.0)), "lng": F.coalesce("_lng", "_tlng", F.lit(0.0))}).drop("_lat", "_lng", "_tlat", "_tlng", "_town")
