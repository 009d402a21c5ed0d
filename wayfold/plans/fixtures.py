"""Queries that first write a listing in the form people keep them, from the driver's tables, and read it back; and forms and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.functions import address, contact, dates, geo, text
from wayfold.operators import audit, directory, mutate, referrals, resolve
from wayfold.plans import views as v
from wayfold.plans.registered import query
from wayfold.sources import exports, listings
from wayfold.sources.shared import new_path


def _written(lines: DataFrame, name: str) -> str:
    """Numbered lines (line, text) as a text file in parts, in their order: its path."""
    path, parts = new_path(lines.sparkSession, name), int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines.repartitionByRange(parts, "line").sortWithinPartitions("line").select("text").write.text(path)
    return path


# ---- listings


def _csv_lines(spark: SparkSession, d: str) -> DataFrame:
    """Clinics as CSV: stray spaces, quoted commas and line breaks, blank lines, short rows and overlong ones, headings."""
    k = F.col("id")
    row = F.concat(F.lit('"'), F.col("name"), F.lit(', LLC" , "'), F.col("address"), F.lit('",'), F.col("county"))
    line = (
        F.when(k % 10 == 0, F.concat("name", F.lit(",only two"))).when(k % 10 == 1, F.concat(row, F.lit(",,extra")))
        .when(k % 10 == 2, F.concat(F.lit("Heading,,"), F.lit("\U0001f7e5 "), F.col("county"), F.lit(","))).when(k % 10 == 3, F.concat(F.lit('"'), F.col("name"), F.lit('\n, LLC","'), F.col("address"), F.lit('",'), F.col("county"), F.lit(", p")))
        .when(k % 10 == 4, "").otherwise(F.concat(row, F.lit(" , +1 "), k.cast("string"), F.lit(" ")))
    )
    rows = v.clinics(spark, d).select(k.alias("line"), line.alias("text"))
    return spark.range(1).select(F.lit(-1).cast("long").alias("line"), F.lit("﻿ Name ,Address, County,Phone ").alias("text")).unionByName(rows)


_CSV = v.CLINICS + """, listed AS (SELECT id, concat(name, CASE WHEN id % 10 = 3 THEN chr(10) ELSE '' END, ', LLC') AS name, address, county,
    CASE id % 10 WHEN 1 THEN '' WHEN 3 THEN 'p' ELSE concat('+1 ', id) END AS phone FROM clinics WHERE id % 10 NOT IN (0, 2, 4)
    UNION ALL SELECT id, 'Heading', '', concat(chr(128997), ' ', county), '' FROM clinics WHERE id % 10 = 2)"""


@query("WITH " + _CSV + " SELECT name AS \"Name\", address AS \"Address\", county AS \"County\", phone AS \"Phone\" FROM listed")
def q_csv_listing(spark, d):
    return listings.read_csv(spark, _written(_csv_lines(spark, d), "csv"), ["Name", "Address", "County", "Phone"])


@query("WITH " + _CSV + ", twice AS (SELECT 'injury' AS area, * FROM listed UNION ALL SELECT 'family', * FROM listed) SELECT area, name, address, county FROM twice WHERE name <> '' AND address <> '' AND NOT contains(county, chr(128997))")
def q_csv_files(spark, d):
    path = _written(_csv_lines(spark, d), "csv")
    rows = listings.read_csv_files(spark, {"injury": path, "family": path, "lost": path + "-missing"}, ["Name", "Address", "County", "Phone"], "area")
    told = rows.select("area", *[listings.picked_field(rows, n, n.lower()).alias(n.lower()) for n in ("Name", "Address", "County")])
    return told.where(~listings.is_section_row(F.col("name"), F.col("address"), F.col("county")))


@query("SELECT n_nationkey AS id, n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def q_json_records(spark, d):
    nations = v.table(spark, d, "nation").join(F.broadcast(v.table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 5 rows
    # fixed tables of 25 and 5 rows: one document
    records = F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("r_name").alias("region")))
    document = nations.agg(F.to_json(F.struct(F.lit("v1").alias("schema"), records.alias("records"))).alias("text")).withColumn("line", F.lit(0))
    return listings.read_json_records(spark, _written(document, "json"), "id int, name string, region string")


@query("SELECT r_regionkey AS id, r_name AS name FROM region")
def q_json_array(spark, d):
    rows = v.table(spark, d, "region").agg(F.to_json(F.collect_list(F.struct(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")))).alias("text"))
    return listings.read_json_records(spark, _written(rows.withColumn("line", F.lit(0)), "json"), "id int, name string", inside=None)


@query("SELECT r_regionkey AS id, r_name AS name FROM region UNION ALL SELECT -1, 'added'")
def q_json_append(spark, d):
    held = v.table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    path = new_path(spark, "json")
    exports.appended_json(held, spark.range(1).select(F.lit(-1).alias("id"), F.lit("added").alias("name")), path)
    return spark.read.schema("id int, name string").json(path)


@query("WITH " + v.CLINICS + """ SELECT name, CASE WHEN id % 3 = 0 THEN concat(address, ' | Annex ', id) ELSE address END AS addresses, CASE WHEN id % 4 <> 0 THEN concat('+1 ', id) END AS phone,
    CASE WHEN id % 5 = 0 THEN concat('www.c', id, '.example') END AS website, region, county FROM clinics WHERE id % 7 <> 0""")
def q_markdown_list(spark, d):
    k = F.col("id")
    lines = F.array(
        F.concat(F.lit("**"), k.cast("string"), F.lit(". "), F.col("name"), F.lit("**")), F.when(k % 7 != 0, F.concat(F.lit("- \U0001f4cd "), F.col("address"))), F.when((k % 3 == 0) & (k % 7 != 0), F.concat(F.lit("\U0001f4cd Annex "), k.cast("string"))),
        F.when(k % 4 != 0, F.concat(F.lit("  \U0001f4de +1 "), k.cast("string"))), F.when(k % 5 == 0, F.concat(F.lit("* \U0001f310 www.c"), k.cast("string"), F.lit(".example"))), F.lit("some remark"),
    )
    own = v.clinics(spark, d).select("region", "county", F.lit(2).alias("level"), k.alias("id"), F.array_join(F.array_compact(lines), "\n").alias("text"))
    heads = own.select("region").distinct().select("region", F.lit("").alias("county"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("id"), F.concat(F.lit("# "), F.col("region")).alias("text"))
    towns = own.select("region", "county").distinct().select("region", "county", F.lit(1).alias("level"), F.lit(0).cast("long").alias("id"), F.concat(F.lit("## "), F.col("county")).alias("text"))
    path = _written(own.unionByName(heads).unionByName(towns).select(F.struct("region", "county", "level", "id").alias("line"), "text"), "markdown")
    return listings.read_markdown(spark, path, whole=True).select("name", F.array_join("addresses", " | ").alias("addresses"), "phone", "website", "region", "county")


@query("WITH " + v.CLINICS + """ SELECT id, CASE id % 3 WHEN 0 THEN lat WHEN 1 THEN 40 + CAST(id % 25 AS DOUBLE) ELSE 0 END AS lat, CASE id % 3 WHEN 0 THEN lng WHEN 1 THEN -90.0 ELSE 0 END AS lng FROM clinics""")
def q_located(spark, d):
    k = F.col("id")
    rows = v.clinics(spark, d).select("id", "lat", "lng", F.concat(k.cast("string"), F.lit(" Main St, "), F.when(k % 3 == 1, F.lit("Town ")).otherwise(F.lit("Nowhere ")), (k % 25).cast("string")).alias("address"))
    exact = rows.where(k % 3 == 0).select(F.col("address").alias("place"), "lat", "lng")
    towns = rows.where(k % 3 == 1).select(F.concat(F.lit("Town "), (k % 25).cast("string")).alias("place"), (40 + (k % 25).cast("double")).alias("lat"), F.lit(-90.0).alias("lng"))
    failed = rows.where(k % 3 == 2).select(F.col("address").alias("place"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"))
    return listings.located(rows.drop("lat", "lng"), exact.unionByName(towns).unionByName(failed)).select("id", "lat", "lng")


@query("SELECT 'Regions' AS title, r_regionkey AS key, r_name AS name FROM region")
def q_document(spark, d):
    regions = v.table(spark, d, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"), F.lit("x").alias("secret"))
    # the five rows of a fixed table, as the array of one document
    page = regions.agg(F.collect_list(F.struct("*")).alias("items")).select(F.lit("page").alias("_type"), F.lit("Regions").alias("title"), "items", F.lit(1).alias("rev"))
    found = directory.document(page.unionByName(page.withColumn("_type", F.lit("footer"))), "page", ["title", "items"], {"items": ["key", "name"]})
    return found.select("title", F.inline("items"))


@query("""SELECT 'nation' AS "table", 'n_nationkey' AS "column", 'string' AS expected, lower(replace(typeof(n_nationkey), 'INTEGER', 'int')) AS found FROM (SELECT * FROM nation LIMIT 1)
    UNION ALL SELECT 'nation', 'n_comment', 'string', NULL UNION ALL SELECT 'region', 'r_name', 'bigint', replace(typeof(r_name), 'VARCHAR', 'string') FROM (SELECT * FROM region LIMIT 1) UNION ALL SELECT 'lost', 'id', 'bigint', NULL""")
def q_schema_gaps(spark, d):
    expected = {"nation": "n_nationkey string, n_name string, n_comment string", "region": "r_regionkey int, r_name long", "lost": "id long"}
    return audit.schema_gaps(spark, {"nation": v.table(spark, d, "nation"), "region": v.table(spark, d, "region")}, {n: T.StructType.fromDDL(s) for n, s in expected.items()})


# ---- addresses and labels by the real rules

_TYPES = list(address.STREET_TYPES)


def _street(k: Column) -> Column:
    kinds = F.array(*[F.lit(t.capitalize()) for t in _TYPES])
    return F.concat((k % 90 + 1).cast("string"), F.lit("  N. Oak "), F.get(kinds, (k % 14).cast("int")), F.when(k % 3 == 0, F.lit(" Ste # 4")).when(k % 3 == 1, F.lit(" – B")).otherwise(F.lit("")), F.lit(" ,CITY"), (k % 25).cast("string"), F.lit(", FL"))


_STREET = "concat(id % 90 + 1, '  N. Oak ', [" + ", ".join(f"'{t.capitalize()}'" for t in _TYPES) + "][id % 14 + 1], CASE id % 3 WHEN 0 THEN ' Ste # 4' WHEN 1 THEN ' – B' ELSE '' END, ' ,CITY', id % 25, ', FL')"


def _regex_sql(expression: str, rules: list[tuple[str, str]]) -> str:
    for pattern, into in rules:
        expression = f"regexp_replace({expression}, '{pattern}', '{into}', 'g')"
    return expression


_SPELLED = _regex_sql(f"lower({_STREET})", [
    (r"\s+", " "), (r",\s*", ", "), (r"\bste\b", "suite"), (r"\bunit\b", "suite"), (r"\bblvd\b", "boulevard"), (r"\bdr\b", "drive"), (r"\bst\b", "street"), (r"\bave\b", "avenue"), (r"\brd\b", "road"),
    (r"\bhwy\b", "highway"), (r"\bpkwy\b", "parkway"), (r"\bln\b", "lane"), (r"\bct\b", "court"), (r"\bpl\b", "place"), (r"\bcir\b", "circle"), (r"\bter\b", "terrace"), (r"[–—\-]+", "-"), (r"suite\s*#?\s*", "suite "), (r"\s+", " "),
])
_CORE = _regex_sql(f"regexp_replace({_regex_sql(f'lower({_STREET})', [(chr(92) + 's+', ' ')])}, ',\\s*fl\\b.*$', '')", [
    (r"\bsuite\b\s*\S*", ""), (r"\bste\b\s*\S*", ""), (r"\bunit\b\s*\S*", ""), (r"\bbuilding\b\s*\S*", ""), (r"(\w)#\s*\S*", r"\1"), (",", " "), (r"\s+", " "), (r"\bn\.?\s*", "n "), (r"\bs\.?\s*", "s "), (r"\be\.?\s*", "e "), (r"\bw\.?\s*", "w "), (r"\bnw\.?\s*", "nw "), (r"\bne\.?\s*", "ne "), (r"\bsw\.?\s*", "sw "), (r"\bse\.?\s*", "se "),
    (r"\bst\.\s", "st "), (r"\bave\.\s", "ave "), (r"\bblvd\.\s", "blvd "), (r"\bdr\.\s", "dr "), (r"\brd\.\s", "rd "), (r"\s+", " "), (r"^\s+|\s+$", ""),
])


@query("WITH " + v.CLINICS + f" SELECT id, {_SPELLED} AS spelled, {_CORE} AS core FROM clinics")
def q_address_forms(spark, d):
    rows = v.clinics(spark, d).select("id", _street(F.col("id")).alias("a"))
    return rows.select("id", address.spelled_out(F.col("a")).alias("spelled"), address.core(F.col("a")).alias("core"))


@query("WITH " + v.CLINICS + """ SELECT id, concat(CASE WHEN id % 4 = 0 THEN 'Town' WHEN id % 4 = 1 THEN concat(name, ', Town, MN') ELSE concat(name, ', Town') END, CASE WHEN id % 4 = 1 THEN '' ELSE ', MN' END, CASE WHEN id % 3 = 0 THEN '' ELSE concat(' ', 55000 + id % 100) END) AS full_address FROM clinics""")
def q_joined_address(spark, d):
    k = F.col("id")
    street, town = F.when(k % 4 != 0, F.col("name")).otherwise(""), F.when(k % 4 == 1, "Town, MN").otherwise("Town,")
    return v.clinics(spark, d).select("id", F.regexp_replace(address.joined([street, F.rtrim(F.regexp_replace(town, ",$", ""))], "MN", F.when(k % 3 != 0, (55000 + k % 100).cast("string"))), r"\s+$", "").alias("full_address"))


_NAMES = ["Hospital Rehab Center", "Hospital for Hand Therapy", "Outpatient Rehab", "Orthopedic and Sports Medicine", "Chiropractic Massage", "PT Clinic", "Neuro Rehab", "Work-related Accident Injury", "Dry Needling Manual Therapy", "Family Doctors"]
_LABELS = [
    "Rehabilitation|Hospital Services", "Physical Therapy|Hospital Services", "Rehabilitation|Outpatient Therapy", "Orthopedic Rehabilitation|Physical Therapy|Sports Medicine", "Chiropractic|Massage Therapy",
    "Physical Therapy", "Rehabilitation|Neurological Rehabilitation", "Work Injury Rehabilitation|Auto Injuries|Injury Clinic", "Manual Therapy|Physical Therapy|Dry Needling", "General Medicine",
]


def _list_sql(items: list[str]) -> str:
    return "[" + ", ".join(f"'{i}'" for i in items) + "]"


@query(f"SELECT s_suppkey AS id, {_list_sql(_LABELS)}[s_suppkey % 10 + 1] AS labels FROM supplier")
def q_service_rules(spark, d):
    k = F.col("s_suppkey")
    name = F.concat(F.lit("The "), F.get(F.array(*[F.lit(n) for n in _NAMES]), (k % 10).cast("int")))
    return v.table(spark, d, "supplier", "s_suppkey").select(k.alias("id"), F.array_join(resolve.labelled(name, resolve.SERVICE_RULES, resolve.DEFAULT_LABEL), "|").alias("labels"))


@query("""SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'Chiropractic|Physical Therapy|Auto Injuries|PIP Claims' WHEN 1 THEN 'Injury Clinic|Auto Injuries|Whiplash Treatment' WHEN 2 THEN 'Pain Management|Spine|Attorney Lien' ELSE 'General Medicine' END AS labels FROM supplier""")
def q_type_and_notes(spark, d):
    k = F.col("s_suppkey") % 4
    kind = F.when(k == 0, " Quiropráctica + PT ").when(k == 1, "clínica de lesiones").otherwise("otra")
    notes = F.when(k == 0, "car accident, PIP").when(k == 1, "latigazo").when(k == 2, "dolor de espalda, abogado")
    return v.table(spark, d, "supplier", "s_suppkey").select(F.col("s_suppkey").alias("id"), F.array_join(resolve.labelled(notes, resolve.NOTE_RULES, resolve.DEFAULT_LABEL, resolve.TYPE_LABELS, kind), "|").alias("labels"))


@query("SELECT s_suppkey AS id, ['Twin Cities Metro', 'Northeast Minnesota', 'Southwest Minnesota', 'Minnesota'][s_suppkey % 4 + 1] AS region FROM supplier")
def q_county_table(spark, d):
    counties = F.array(*[F.lit(c) for c in ("Hennepin", "St. Louis", "Lac qui Parle", "Nowhere")])
    rows = v.table(spark, d, "supplier", "s_suppkey").select(F.col("s_suppkey").alias("id"), F.get(counties, (F.col("s_suppkey") % 4).cast("int")).alias("county"))
    return resolve.with_region(rows, "county").select("id", "region")


@query("WITH " + v.CLINICS + ", tagged AS (SELECT id, [CASE id % 3 WHEN 0 THEN 'NEUROLOGY' WHEN 1 THEN 'Imaging' ELSE 'pt' END] AS tags FROM clinics) SELECT id, id % 3 = 0 AS neurologist, id % 3 = 1 AS radiologist, id % 3 = 2 AS therapist, false AS other FROM tagged")
def q_specialist_table(spark, d):
    k = F.col("id") % 3
    rows = v.clinics(spark, d).select("id", F.array(F.when(k == 0, "NEUROLOGY").when(k == 1, "Imaging").otherwise("pt")).alias("tags"))
    kinds = {"neurologist": "Neurologist", "radiologist": "Radiologist", "therapist": "Physical Therapist", "other": "Other"}
    return rows.select("id", *[directory.matches_specialist("tags", directory.SPECIALIST_TAGS[s]).alias(n) for n, s in kinds.items()])


# ---- forms


@query("""WITH u AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'ab' WHEN 1 THEN concat('User_', c_custkey) WHEN 2 THEN 'has space' WHEN 3 THEN NULL ELSE repeat('x', 31) END AS name, ['lawyer', 'clinic', 'root', NULL][c_custkey % 4 + 1] AS role FROM customer)
    SELECT id, coalesce(regexp_matches(name, '^[a-zA-Z0-9_]{3,30}$'), false) AS username_ok, coalesce(role IN ('lawyer', 'clinic', 'admin', 'referrer', 'partner'), false) AS role_ok FROM u""")
def q_username_and_role(spark, d):
    k = F.col("c_custkey")
    name = F.when(k % 5 == 0, "ab").when(k % 5 == 1, F.concat(F.lit("User_"), k.cast("string"))).when(k % 5 == 2, "has space").when(k % 5 == 4, "x" * 31)
    role = F.when(k % 4 == 0, "lawyer").when(k % 4 == 1, "clinic").when(k % 4 == 2, "root")
    return v.table(spark, d, "customer", "c_custkey").select(k.alias("id"), contact.is_username(name).alias("username_ok"), contact.is_one_of(role, contact.ROLES).alias("role_ok"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name, CASE WHEN c_custkey % 3 <> 1 THEN c_acctbal END AS lat, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal >= 0 END AS available FROM customer""")
def q_patch_of(spark, d):
    k = F.col("c_custkey")
    body = F.to_json(F.struct(F.when(k % 3 != 0, F.col("c_name")).alias("name"), F.when(k % 3 != 1, F.col("c_acctbal")).alias("lat"), F.when(k % 2 == 0, F.col("c_acctbal") >= 0).alias("available"), F.lit("x").alias("password")))
    rows = v.table(spark, d, "customer", "c_custkey", "c_name", "c_acctbal").select(k.alias("id"), contact.patch_of(body, {"name": "string", "lat": "double", "available": "boolean"}).alias("p"))
    return rows.select("id", "p.*")


@query("SELECT c_custkey AS id, c_name AS firm_name, c_mktsegment AS practice_area FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_name, NULL FROM customer WHERE c_custkey % 2 = 1")
def q_renamed_patch(spark, d):
    k = F.col("c_custkey")
    body = F.to_json(F.struct(F.col("c_name").alias("firmName"), F.when(k % 2 == 0, F.col("c_mktsegment")).alias("practiceArea"), F.lit(True).alias("isAdmin")))
    rows = v.table(spark, d, "customer", "c_custkey", "c_name", "c_mktsegment").select(k.alias("id"), mutate.renamed_patch(body, {"firmName": "string", "practiceArea": "string"}, {"firmName": "firm_name", "practiceArea": "practice_area"}).alias("p"))
    return rows.select("id", "p.*")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 100 AS VARCHAR) END AS clinic_id, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) END AS lawyer_id,
    CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0 THEN 'assigned_both' WHEN o_orderkey % 3 <> 0 THEN 'assigned_clinic' WHEN o_orderkey % 2 = 0 THEN 'assigned_lawyer' ELSE 'updated' END AS action FROM orders""")
def q_assignment(spark, d):
    k = F.col("o_orderkey")
    body = F.struct(F.when(k % 3 != 0, (k % 100).cast("string")).otherwise("").alias("clinic_id"), F.when(k % 2 == 0, F.col("o_custkey").cast("string")).otherwise("").alias("lawyer_id"))
    return v.table(spark, d, "orders", "o_orderkey", "o_custkey").select(k.alias("id"), mutate.assignment(body).alias("a")).select("id", "a.*")


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE concat(p_brand, '|', p_type) END AS tags, CASE WHEN p_size % 2 = 0 THEN concat(p_brand, '|', p_type) ELSE concat(p_brand, '|', p_type) END AS added FROM part""")
def q_array_changes(spark, d):
    even = F.col("p_size") % 2 == 0
    items = F.array(F.concat(F.lit(" <b>"), F.col("p_brand"), F.lit("</b> ")), F.lit(None).cast("string"), F.when(even, F.lit(" ")).otherwise(F.col("p_type")), F.lit("<i></i>"))
    rows = v.table(spark, d, "part", "p_partkey", "p_brand", "p_type", "p_size").withColumn("tags", text.cleaned(items))
    return rows.select(F.col("p_partkey").alias("id"), F.array_join("tags", "|").alias("tags"), F.array_join(text.with_item(text.with_item(F.col("tags"), F.col("p_type")), F.lit("")), "|").alias("added"))


@query("""SELECT o_orderkey AS id, CAST(o_orderkey % 1000 AS DOUBLE) + 0.5 AS f, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 1000 END AS i, o_orderkey % 4 <> 0 AS finite, round(CAST(o_orderkey % 1000 AS DOUBLE) / 8 * 8 + 0.25, 1) AS shown FROM orders""")
def q_numbers(spark, d):
    k = F.col("o_orderkey")
    said = F.concat(F.lit(" "), (k % 1000).cast("string"), F.lit(".5 miles"))
    whole = F.when(k % 4 != 0, F.concat((k % 1000).cast("string"), F.lit("px"))).otherwise("none")
    number = F.when(k % 4 != 0, k.cast("string")).otherwise(F.when(k % 8 == 0, "NaN").otherwise("abc"))
    return v.table(spark, d, "orders", "o_orderkey").select(k.alias("id"), text.parsed_float(said).alias("f"), text.parsed_int(whole).alias("i"), contact.is_finite_number(number).alias("finite"), text.one_decimal((k % 1000) + 0.25).alias("shown"))


@query("SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'Name=' || c_name || ';Segment=' || c_mktsegment WHEN 1 THEN 'Name=' || c_name WHEN 2 THEN 'Segment=' || c_mktsegment ELSE '' END AS rows, concat('c-', substr(sha256(concat(c_custkey, chr(31), c_name)), 1, 8)) AS key FROM customer")
def q_labelled_rows(spark, d):
    k = F.col("c_custkey")
    pairs = {"Name": F.when(k % 4 < 2, F.col("c_name")).otherwise(" "), "Segment": F.when(k % 2 == 0, F.col("c_mktsegment"))}
    rows = v.table(spark, d, "customer", "c_custkey", "c_name", "c_mktsegment").select(k.alias("id"), text.labelled(pairs).alias("r"), text.derived_key("c-", k, F.col("c_name")).alias("key"))
    return rows.select("id", F.array_join(F.transform("r", lambda r: F.concat(r.label, F.lit("="), r.value)), ";").alias("rows"), "key")


@query("SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN true ELSE false END AS heading, CASE WHEN event_id % 4 = 0 THEN true ELSE ts < TIMESTAMP '2024-01-15 11:55:00' END AS stale FROM events")
def q_headings_and_staleness(spark, d):
    k = F.col("event_id")
    line = F.concat(F.when(k % 3 == 0, "\U0001f7e6 ").when(k % 3 == 1, " \U0001f7e6").otherwise(""), F.col("event_type"))
    seen = F.when(k % 4 != 0, F.date_trunc("second", F.col("ts").cast("timestamp")))
    return v.table(spark, d, "events", "event_id", "event_type", "ts").select(k.alias("id"), text.starts_with_pictograph(line).alias("heading"), dates.is_stale(seen, F.lit("2024-01-15 12:00:00").cast("timestamp")).alias("stale"))


@query("SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 6 = 0")
def q_without_coordinates(spark, d):
    k = F.col("s_suppkey")
    rows = v.table(spark, d, "supplier", "s_suppkey").select(k.alias("id"), (k % 2).cast("double").alias("lat"), (k % 3).cast("double").alias("lng"))
    return rows.where(geo.lacks_coordinates(F.col("lat"), F.col("lng"))).select("id")


# ---- changes, visibility, search


@query("WITH " + v.REFERRALS + ", " + v.USERS + """ SELECT r.id, CASE WHEN r.id % 3 = 0 AND r.lawyer_id IS NOT NULL AND u.lawyer_id IS NOT NULL AND r.lawyer_id = u.id THEN u.lawyer_id + 1000000 ELSE r.lawyer_id END AS lawyer_id
    FROM referrals r LEFT JOIN users u ON u.id = r.clinic_id + 1""")
def q_rewritten_links(spark, d):
    rows = v.referrals(spark, d).select("id", "lawyer_id", (F.col("clinic_id") + 1).alias("creator"), F.when(F.col("id") % 3 == 0, "lawyer").otherwise("clinic").alias("creator_role"))
    linked = v.users(spark, d).where("lawyer_id IS NOT NULL").select(F.col("id").alias("creator"), "lawyer_id")
    stale = (F.col("creator_role") == "lawyer") & (F.col("lawyer_id") == F.col("creator"))
    run = lambda df: mutate.rewritten(df, linked.withColumnRenamed("lawyer_id", "firm"), "creator", "lawyer_id", F.col("firm") + 1000000, stale)
    return run(run(rows)).select("id", "lawyer_id")


@query("""SELECT event_id AS id, event_type AS action, ts AS created_at FROM events UNION ALL SELECT (SELECT max(event_id) FROM events) + row_number() OVER (ORDER BY r_name), concat('seen ', r_name), TIMESTAMP '2024-02-01' FROM region""")
def q_audit_log(spark, d):
    log = v.table(spark, d, "events", "event_id", "event_type", "ts").select(F.col("event_id").alias("id"), F.col("event_type").alias("action"), F.col("ts").cast("timestamp").alias("created_at"))
    entries = v.table(spark, d, "region", "r_name").select(F.concat(F.lit("seen "), F.col("r_name")).alias("action"))
    return mutate.logged(log, entries, "id", "2024-02-01").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@query("""SELECT 'Name,Message' AS line UNION ALL SELECT concat('"', c_name, '","say ""', c_mktsegment, '"", twice"') FROM customer""")
def q_contact_export(spark, d):
    rows = v.table(spark, d, "customer", "c_name", "c_mktsegment").select(F.col("c_name").alias("name"), F.concat(F.lit('say "'), F.col("c_mktsegment"), F.lit('", twice')).alias("message"))
    return spark.range(1).select(F.lit(exports.header_line(["Name", "Message"])).alias("line")).unionByName(exports.contact_lines(rows, ["name", "message"]))


@query("""SELECT o_orderkey AS id, CASE WHEN o_custkey % 10 = 0 OR o_orderkey % 10 = 0 THEN NULL ELSE c_name END AS firm, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE s_name END AS clinic,
    CASE WHEN o_orderkey % 7 = 0 THEN 'Clinic not found' WHEN o_custkey % 10 = 0 AND o_orderkey % 10 <> 0 THEN 'Your firm record was not found' END AS error
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN supplier ON o_orderkey % 50 = s_suppkey WHERE o_orderkey % 50 < (SELECT count(*) FROM supplier)""")
def q_create_lookups(spark, d):
    k = F.col("o_orderkey")
    clinics = v.table(spark, d, "supplier", "s_suppkey", "s_name")
    rows = v.table(spark, d, "orders", "o_orderkey", "o_custkey").join(F.broadcast(clinics.agg(F.count("*").alias("n")))).where(k % 50 < F.col("n"))
    rows = rows.select(k.alias("id"), F.when(k % 7 == 0, -1).otherwise(k % 50).alias("clinic_id"), F.when(k % 10 != 0, F.col("o_custkey")).alias("firm_id"))
    firms = v.table(spark, d, "customer", "c_custkey", "c_name").where("c_custkey % 10 <> 0")
    lookups = {"clinic_id": (clinics, "s_suppkey", {"s_name": "clinic"}, "Clinic not found"), "firm_id": (firms, "c_custkey", {"c_name": "firm"}, "Your firm record was not found")}
    return referrals.with_lookups(rows, lookups).select("id", "firm", "clinic", "error")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 1 THEN o_orderpriority END AS coverage, CASE WHEN o_orderkey % 2 = 1 THEN coalesce(o_orderstatus, '') END AS firm, o_orderpriority AS case_type FROM orders")
def q_variant_columns(spark, d):
    kind = F.when(F.col("o_orderkey") % 2 == 0, "medical_specialist").otherwise("lawyer")
    same = {"case_type": F.col("o_orderpriority")}
    chosen = referrals.variant(kind, {"medical_specialist": same, "lawyer": {"firm": F.col("o_orderstatus"), "coverage": F.col("o_orderpriority")} | same})
    return v.table(spark, d, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus").select(F.col("o_orderkey").alias("id"), *chosen)


@query("WITH " + v.REFERRALS + " SELECT id, case_type FROM referrals WHERE lawyer_id = 11")
def q_referrers_own(spark, d):
    rows = v.referrals(spark, d).withColumnRenamed("lawyer_id", "referrer_id")
    return directory.without(referrals.visible_to(rows, "referrer", user_id=11), "clinic_id", "target_clinic_id").select("id", "case_type")


@query("WITH " + v.REFERRALS + " SELECT id FROM referrals WHERE status = 'F'")
def q_secured_view(spark, d):
    policies = {"admin": F.lit(True), "auditor": F.col("status") == "F"}
    return referrals.secured(v.referrals(spark, d), policies, "auditor", "visible_referrals").select("id")


_PARTNERS = "partners AS (SELECT o_orderkey AS id, c_name AS client_name, concat('ref ', c_mktsegment) AS referrer_name, o_orderpriority AS case_type, o_orderstatus AS status FROM orders JOIN customer ON o_custkey = c_custkey)"


def _partners(spark: SparkSession, d: str) -> DataFrame:
    rows = v.table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus").join(v.table(spark, d, "customer", "c_custkey", "c_name", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("client_name"), F.concat(F.lit("ref "), F.col("c_mktsegment")).alias("referrer_name"), F.col("o_orderpriority").alias("case_type"), F.col("o_orderstatus").alias("status"))


@query("WITH " + _PARTNERS + " SELECT id FROM partners WHERE status = 'O' AND (contains(lower(client_name), 'build') OR contains(lower(referrer_name), 'build') OR contains(lower(case_type), 'build'))")
def q_search_partner_admin(spark, d):
    rows = directory.where_given(_partners(spark, d), [("O", F.col("status") == "O"), ("", F.lit(False))])
    return rows.where(directory.contains_any("BUILD", ["client_name", "referrer_name", "case_type"])).select("id")


@query("WITH " + _PARTNERS + " SELECT id FROM partners WHERE contains(lower(client_name), 'urg') OR contains(lower(case_type), 'urg')")
def q_search_partner_own(spark, d):
    return _partners(spark, d).where(directory.contains_any("urg", ["client_name", "case_type"])).select("id")


@query("WITH " + v.CLINICS + " SELECT id, name FROM clinics WHERE contains(lower(name), 'city1') OR contains(lower(address), 'city1') ORDER BY name, id LIMIT 20")
def q_picker_clinics(spark, d):
    return directory.picked(v.clinics(spark, d), "City1", ["name", "address"]).select("id", "name")


@query("WITH " + v.FIRMS + " SELECT id, name FROM firms WHERE contains(lower(name), 'am') OR contains(lower(region), 'am') OR contains(lower(county), 'am') ORDER BY name, id LIMIT 20")
def q_picker_firms(spark, d):
    return directory.picked(v.firms(spark, d), "am", ["name", "region", "county"]).select("id", "name")
