"""Matching records: deduplication, merging, keys that differ in spelling, tokens, domains, addresses, orphans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.functions import address as addresses
from wayfold.functions.contact import email_domain
from wayfold.functions.text import name_tokens
from wayfold.operators.containment import contained, least_related
from wayfold.operators.mutate import settled

#: Matches of names (three columns) are broadcast up to so many rows; beyond it the join shuffles.
BROADCAST_ROWS = 100_000


def first_wins(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key. The ranking limits each task before the shuffle, so hot keys stay small."""
    named = df.withColumns({f"_k{i}": k for i, k in enumerate(keys)})
    rank = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy(*order)
    return named.withColumn("_nth", F.row_number().over(rank)).where("_nth = 1").drop("_nth", *[f"_k{i}" for i in range(len(keys))])


def top_of_each(df: DataFrame, groups: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each group."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("nth") <= most)


def merged_tags(df: DataFrame, keys: list[str], tag: str, order: str, first: list[str] = ()) -> DataFrame:
    """A row for each key: the sorted set of its tags, and of other columns the value of its first row."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_set(tag)).alias("tags"), *[F.min_by(c, order).alias(c) for c in first])


def unknown(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key no existing row has."""
    return new.join(existing.select(*keys), keys, "left_anti")


def orphans(df: DataFrame, column: str, parents: DataFrame, parent_key: str, strict: bool = False) -> DataFrame:
    """Rows that refer to no parent; null references are orphans too unless ``strict``."""
    rows = df.where(F.col(column).isNotNull()) if strict else df
    return rows.join(parents.select(F.col(parent_key).alias(column)), column, "left_anti")


def ignoring_case(left: DataFrame, right: DataFrame, on: str, keep: str) -> DataFrame:
    """Left rows with ``keep`` of the right row whose ``on`` is equal but for case, the least of several."""
    one = right.groupBy(F.lower(on).alias("_on")).agg(F.min(keep).alias(keep))
    return left.withColumn("_on", F.lower(on)).join(one, "_on", "left").drop("_on")


def by_token(left: DataFrame, right: DataFrame, left_name: str, right_name: str, most: int = 10) -> DataFrame:
    """Right rows whose name contains a telling word of the left name: ``most`` by name for each word, every pair once.

    Names are matched, not rows: of equal right names only the ``most`` least ids can be among a word's first, and left rows with one name
    have the same matches. Both sides are dealt by their ids in as many parts as shuffles have, however few bytes their files take, so
    that neither the sort of the one nor the pairs of the other come down to one task.
    """
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = left.select("id", F.col(left_name).alias("asked_name")).repartition(parts, "id").distinct()
    words = asked.select("asked_name").distinct().select("asked_name", F.explode(F.array_distinct(name_tokens(F.col("asked_name")))).alias("token"))
    names = right.select(F.col("id").alias("match_id"), F.col(right_name).alias("match_name")).repartition(parts, "match_id")
    firsts = top_of_each(names, ["match_name"], [F.col("match_id")], most).drop("nth").withColumn("lower_name", F.lower("match_name"))
    hits = contained(words.select("token").distinct(), firsts, "token", "lower_name")
    best = top_of_each(hits, ["token"], [F.col("match_name"), F.col("match_id")], most)
    of_name = settled(words.join(best, "token").select("asked_name", "match_id", "match_name").distinct())
    told = F.broadcast(of_name) if of_name.count() <= BROADCAST_ROWS else of_name
    return asked.join(told, "asked_name").select("id", "match_id", "match_name").distinct()


def by_domain(users: DataFrame, entities: DataFrame, most: int = 5) -> DataFrame:
    """Entities with a user's e-mail domain, ``most`` by name. They are ranked by domain first: users only join the ranks."""
    named = entities.select(email_domain(F.col("email")).alias("domain"), F.col("id").alias("match_id"), F.col("name").alias("match_name")).where("domain IS NOT NULL")
    ranked = top_of_each(named, ["domain"], [F.col("match_name"), F.col("match_id")], most).drop("nth")
    return users.select("id", email_domain(F.col("email")).alias("domain")).join(ranked, "domain")


def by_state(users: DataFrame, entities: DataFrame, most: int = 15) -> DataFrame:
    """Entities in a user's state, ``most`` by name. They are ranked by state first: users only join the ranks."""
    ranked = top_of_each(entities.where("state <> ''").select("state", F.col("id").alias("match_id"), F.col("name").alias("match_name")), ["state"], [F.col("match_name"), F.col("match_id")], most)
    return users.select("id", "state").join(ranked, "state")


def matched_once(df: DataFrame, patches: DataFrame, on: str, updates: dict[str, str]) -> DataFrame:
    """Rows changed by the patch of their name, if the name belongs to exactly one row."""
    sole = df.groupBy(on).agg(F.count("*").alias("_n")).where("_n = 1").select(on)
    sure = patches.join(sole, on)
    return df.join(sure, on, "left").withColumns({c: F.coalesce(F.col(p), F.col(c)) for c, p in updates.items()}).drop(*updates.values())


def by_address(new: DataFrame, existing: DataFrame, state: str = "fl") -> DataFrame:
    """New addresses with the first existing one (by ``place``) that seems the same, null if none does.

    The same: equal cores; equal city, and streets of which one contains the other; equal city, number and first street
    word. Each side is read and put in its forms once. Equal keys meet through the first existing row of each key, streets
    inside streets in one sorted pass (``least_related``): no pair of addresses is compared.
    """

    def read(df: DataFrame, *more: str) -> DataFrame:
        a = F.col("address")
        told = df.select("id", "address", *more, addresses.core(a, state).alias("core"), addresses.city(a, state).alias("city"), addresses.house_digit(a).alias("number"))
        return settled(told.withColumn("word", addresses.first_street_word(F.col("core"))))

    n, e = read(new), read(existing, "place").withColumn("m", F.struct("place", "id", "address"))
    loose = ["city", "number", "word"]
    counts = " AND ".join(f"{c} <> ''" for c in loose)
    same_core = e.groupBy("core").agg(F.min("m").alias("m_core"))
    same_street = e.where(counts).groupBy(*loose).agg(F.min("m").alias("m_street"))
    related = least_related(n.where("city <> '' AND core <> ''"), e.where("city <> '' AND core <> ''"), "city", "core", "m").withColumnRenamed("m", "m_related")
    found = n.join(same_core, "core", "left").join(same_street, loose, "left").join(related, ["city", "core"], "left")
    best = F.array_min(F.array_compact(F.array("m_core", "m_street", "m_related")))
    told = found.groupBy("id").agg(F.min(best).alias("m")).select("id", F.col("m.id").alias("match_id"), F.col("m.address").alias("matched_with"))
    return new.join(told, "id", "left").withColumn("full", ~addresses.is_vague(F.col("address")))


def labelled(text: Column, rules: list[tuple[str, list[str]]], default: str, exact: dict[str, list[str]] | None = None, kind: Column | None = None) -> Column:
    """The labels of all rules whose pattern occurs, in rule order without repeats; the default if none does."""
    found = [F.when(F.coalesce(text.rlike(p), F.lit(False)), F.array(*[F.lit(x) for x in labels])).otherwise(F.array().cast("array<string>")) for p, labels in rules]
    if exact and kind is not None:
        known = F.create_map(*[x for k, v in exact.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))])
        found.insert(0, F.coalesce(known[F.lower(F.trim(kind))], F.array().cast("array<string>")))
    labels = F.array_distinct(F.flatten(F.array(*found)))
    return F.when(F.size(labels) == 0, F.array(F.lit(default))).otherwise(labels)


# What clinics are called by the services they name.
SERVICE_RULES = [
    (r"(?i)hospital\s+rehab", ["Rehabilitation", "Hospital Services"]),
    (r"(?i)hospital.*therapy", ["Physical Therapy", "Hospital Services"]),
    (r"(?i)hospital.*PT", ["Physical Therapy", "Hospital Services"]),
    (r"(?i)outpatient\s+rehab", ["Rehabilitation", "Outpatient Therapy"]),
    (r"(?i)outpatient.*therapy", ["Physical Therapy", "Outpatient Therapy"]),
    (r"(?i)orthopedic", ["Orthopedic Rehabilitation", "Physical Therapy"]),
    (r"(?i)sports?\s+medicine", ["Sports Medicine"]),
    (r"(?i)sports?\s+injur", ["Sports Medicine", "Rehabilitation"]),
    (r"(?i)chiropract", ["Chiropractic"]),
    (r"(?i)massage", ["Massage Therapy"]),
    (r"(?i)physical\s+therap|PT\s+clinic", ["Physical Therapy"]),
    (r"(?i)rehab", ["Rehabilitation"]),
    (r"(?i)manual\s+therapy", ["Manual Therapy", "Physical Therapy"]),
    (r"(?i)dry\s+needling", ["Dry Needling"]),
    (r"(?i)neuro", ["Neurological Rehabilitation"]),
    (r"(?i)work.?related", ["Work Injury Rehabilitation"]),
    (r"(?i)accident", ["Auto Injuries"]),
    (r"(?i)injury", ["Injury Clinic"]),
]
# Types of clinic as listings spell them, and what notes speak of.
TYPE_LABELS = {
    "quiropráctica": ["Chiropractic"],
    "quiropráctica + pt": ["Chiropractic", "Physical Therapy"],
    "quiropráctica + rehab": ["Chiropractic", "Rehabilitation"],
    "clínica de lesiones": ["Injury Clinic", "Auto Injuries"],
    "clínica médica": ["Medical Clinic"],
    "terapia física": ["Physical Therapy"],
    "manejo del dolor": ["Pain Management"],
}
NOTE_RULES = [
    (r"(?i)auto.?accident|auto.?injur|accidente|car.?accident|choques|mva|motor vehicle", ["Auto Injuries"]),
    (r"(?i)whiplash|latigazo", ["Whiplash Treatment"]),
    (r"(?i)rehabilitaci[oó]n|rehab", ["Rehabilitation"]),
    (r"(?i)dolor|pain", ["Pain Management"]),
    (r"(?i)pip", ["PIP Claims"]),
    (r"(?i)spine|espinal|espalda|columna|cuello", ["Spine"]),
    (r"(?i)sport|deport", ["Sports Medicine"]),
    (r"(?i)abogado|attorney|seguro|insurance", ["Attorney Lien"]),
]
DEFAULT_LABEL = "General Medicine"
# The region of each county.
REGIONS = [
    ("Hennepin", "Twin Cities Metro"),
    ("Ramsey", "Twin Cities Metro"),
    ("Dakota", "Twin Cities Metro"),
    ("Scott", "Twin Cities Metro"),
    ("Washington", "Twin Cities Metro"),
    ("Anoka", "Twin Cities Metro"),
    ("Carver", "Twin Cities Metro"),
    ("Wright", "Twin Cities Metro"),
    ("Sherburne", "Twin Cities Metro"),
    ("Olmsted", "Southeast Minnesota"),
    ("Winona", "Southeast Minnesota"),
    ("Wabasha", "Southeast Minnesota"),
    ("Fillmore", "Southeast Minnesota"),
    ("Houston", "Southeast Minnesota"),
    ("Goodhue", "Southeast Minnesota"),
    ("Dodge", "Southeast Minnesota"),
    ("Mower", "Southeast Minnesota"),
    ("Freeborn", "Southeast Minnesota"),
    ("Steele", "Southeast Minnesota"),
    ("Rice", "Southeast Minnesota"),
    ("Waseca", "Southeast Minnesota"),
    ("Le Sueur", "Southeast Minnesota"),
    ("Blue Earth", "South Central Minnesota"),
    ("Nicollet", "South Central Minnesota"),
    ("Brown", "South Central Minnesota"),
    ("Watonwan", "South Central Minnesota"),
    ("Martin", "South Central Minnesota"),
    ("Faribault", "South Central Minnesota"),
    ("Jackson", "South Central Minnesota"),
    ("Cottonwood", "South Central Minnesota"),
    ("Murray", "South Central Minnesota"),
    ("Lyon", "Southwest Minnesota"),
    ("Redwood", "Southwest Minnesota"),
    ("Yellow Medicine", "Southwest Minnesota"),
    ("Lac qui Parle", "Southwest Minnesota"),
    ("Lincoln", "Southwest Minnesota"),
    ("Pipestone", "Southwest Minnesota"),
    ("Rock", "Southwest Minnesota"),
    ("Nobles", "Southwest Minnesota"),
    ("Big Stone", "Southwest Minnesota"),
    ("Chippewa", "Southwest Minnesota"),
    ("Renville", "Southwest Minnesota"),
    ("Swift", "Southwest Minnesota"),
    ("Kandiyohi", "Southwest Minnesota"),
    ("Traverse", "Southwest Minnesota"),
    ("Stearns", "Central Minnesota"),
    ("Benton", "Central Minnesota"),
    ("Morrison", "Central Minnesota"),
    ("Mille Lacs", "Central Minnesota"),
    ("Kanabec", "Central Minnesota"),
    ("Todd", "Central Minnesota"),
    ("Douglas", "West Central Minnesota"),
    ("Otter Tail", "West Central Minnesota"),
    ("Grant", "West Central Minnesota"),
    ("Wilkin", "West Central Minnesota"),
    ("Clay", "West Central Minnesota"),
    ("Polk", "Northwest Minnesota"),
    ("Norman", "Northwest Minnesota"),
    ("Mahnomen", "Northwest Minnesota"),
    ("Red Lake", "Northwest Minnesota"),
    ("Pennington", "Northwest Minnesota"),
    ("Marshall", "Northwest Minnesota"),
    ("Kittson", "Northwest Minnesota"),
    ("Roseau", "Northwest Minnesota"),
    ("Lake of the Woods", "Northwest Minnesota"),
    ("St. Louis", "Northeast Minnesota"),
    ("Lake", "Northeast Minnesota"),
    ("Cook", "Northeast Minnesota"),
    ("Itasca", "Northeast Minnesota"),
    ("Koochiching", "Northeast Minnesota"),
    ("Carlton", "Northeast Minnesota"),
    ("Crow Wing", "Northeast Minnesota"),
    ("Cass", "Northeast Minnesota"),
    ("Hubbard", "Northeast Minnesota"),
    ("Beltrami", "Northeast Minnesota"),
    ("Aitkin", "Northeast Minnesota"),
    ("Clearwater", "Northeast Minnesota"),
    ("Becker", "Northeast Minnesota"),
]
DEFAULT_REGION = "Minnesota"


def with_region(df: DataFrame, county: str, regions: DataFrame | None = None, default: str = DEFAULT_REGION) -> DataFrame:
    """``region`` of the county, from (county, region) rows or else the fixed table."""
    if regions is None:
        regions = F.broadcast(df.sparkSession.createDataFrame(REGIONS, "county string, region string"))
    known = regions.select(F.col("county").alias(county), "region")
    return df.join(known, county, "left").withColumn("region", F.coalesce("region", F.lit(default)))
