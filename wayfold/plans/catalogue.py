"""Every registered query with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import address, contact, dates, geo, text
from wayfold.operators import audit, clustering, directory, facets, mutate, nearby, pages, referrals, resolve, textindex
from wayfold.plans import fixtures  # noqa: F401  registers its queries
from wayfold.plans import views as v
from wayfold.plans.registered import QUERIES, SQL, query
from wayfold.sources import exports, listings, versions
from wayfold.sources.shared import new_path
from wayfold.streaming import activity, maintained

NOW = "2001-08-01"
STATUSES = {"P": "received", "O": "in_process", "F": "attended"}


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    return dict(SQL)


# ---- dashboard


@query("""SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'P') AS received, count(*) FILTER (o_orderstatus = 'O') AS in_process, count(*) FILTER (o_orderstatus = 'F') AS attended,
    CASE WHEN count(*) > 0 THEN CAST(floor(count(*) FILTER (o_orderstatus = 'F') / count(*) * 100 + 0.5) AS BIGINT) ELSE 0 END AS completion FROM orders""")
def q_status_kpi(spark, d):
    return referrals.status_counts(v.table(spark, d, "orders", "o_orderstatus"), "o_orderstatus", STATUSES, "attended")


@query("""WITH domain AS (SELECT * FROM (VALUES (0, 'P', 'Received'), (1, 'O', 'In process'), (2, 'F', 'Attended'), (3, 'X', 'Cancelled')) t(place, status, label))
    SELECT place, label, count(o_orderkey) AS value FROM domain LEFT JOIN orders ON o_orderstatus = status GROUP BY place, label""")
def q_status_breakdown_zero(spark, d):
    return referrals.breakdown(v.table(spark, d, "orders", "o_orderstatus"), "o_orderstatus", {"P": "Received", "O": "In process", "F": "Attended", "X": "Cancelled"})


@query("""WITH m AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2001-03-01', TIMESTAMP '2001-08-01', INTERVAL 1 MONTH)) AS DATE) AS month)
    SELECT strftime(m.month, '%Y-%m') AS month, strftime(m.month, '%b') AS label, count(o_orderkey) AS value FROM m LEFT JOIN orders ON CAST(date_trunc('month', o_orderdate) AS DATE) = m.month GROUP BY m.month""")
def q_monthly_last6(spark, d):
    return referrals.last_months(v.table(spark, d, "orders", "o_orderdate"), "o_orderdate", NOW).withColumn("month", F.date_format("month", "yyyy-MM"))


@query("SELECT c_name AS name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 ORDER BY n DESC, name LIMIT 5")
def q_top5_firms(spark, d):
    # ranked by key before the names are joined would break ties otherwise: names are unique, so counts per key are counts per name
    counted = v.table(spark, d, "orders", "o_custkey").groupBy("o_custkey").agg(F.count("*").alias("n"))
    named = counted.join(v.table(spark, d, "customer", "c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    return named.groupBy(F.col("c_name").alias("name")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "name").limit(5)


@query("SELECT CAST(l_suppkey AS VARCHAR) AS name, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, name LIMIT 5")
def q_top5_clinics(spark, d):
    return referrals.leaders(v.table(spark, d, "lineitem", "l_suppkey").select(F.col("l_suppkey").cast("string").alias("clinic")), "clinic")


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 5")
def q_recent5(spark, d):
    return referrals.recent(v.table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate"), "o_orderdate", "o_orderkey")


@query("SELECT (SELECT count(*) FROM customer) AS firms, (SELECT count(*) FROM supplier) AS clinics, (SELECT count(*) FROM orders) AS referrals")
def q_table_counts(spark, d):
    return audit.table_counts({"firms": v.table(spark, d, "customer"), "clinics": v.table(spark, d, "supplier"), "referrals": v.table(spark, d, "orders")})


@query(" UNION ALL ".join(f"SELECT '{n}' AS \"check\", (SELECT count(*) FROM {t}) > 0 AS ok" for n, t in (("customer", "customer"), ("supplier", "supplier"), ("orders", "orders"), ("nothing", "(SELECT * FROM region WHERE r_regionkey < 0)"))))
def q_health(spark, d):
    return audit.health({n: v.table(spark, d, n) for n in ("customer", "supplier", "orders")} | {"nothing": v.table(spark, d, "region").where("r_regionkey < 0")})


# ---- visibility and filters


@query("SELECT id, status, lawyer_id FROM (WITH " + v.REFERRALS + " SELECT * FROM referrals) WHERE lawyer_id = 7")
def q_visible_firm(spark, d):
    return referrals.visible_to(v.referrals(spark, d), "lawyer", firm_id=7).select("id", "status", "lawyer_id")


@query("WITH " + v.REFERRALS + " SELECT id, clinic_id, target_clinic_id FROM referrals WHERE clinic_id = 12 OR target_clinic_id = 12")
def q_visible_source_or_target(spark, d):
    return referrals.visible_to(v.referrals(spark, d), "clinic", clinic_id=12).select("id", "clinic_id", "target_clinic_id")


@query("WITH " + v.REFERRALS + " SELECT id, coalesce(lawyer_id = 7, false) AS editable FROM referrals")
def q_may_edit(spark, d):
    return v.referrals(spark, d).select("id", referrals.may_edit(F.lit("lawyer"), F.lit(None).cast("long"), F.lit(7).cast("long")).alias("editable"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (1, 5, 9, 77)")
def q_in_list(spark, d):
    return v.table(spark, d, "supplier", "s_suppkey", "s_name").where(F.col("s_suppkey").isin(1, 5, 9, 77))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (1, 5, 9, 77) AND s_nationkey <> 3")
def q_not_in_list(spark, d):
    return v.table(spark, d, "supplier", "s_suppkey", "s_name", "s_nationkey").where(~F.col("s_suppkey").isin(1, 5, 9, 77) & (F.col("s_nationkey") != 3)).select("s_suppkey", "s_name")


@query("WITH " + v.REFERRALS + " SELECT id FROM referrals WHERE lawyer_id IS NULL")
def q_is_null(spark, d):
    return v.referrals(spark, d).where(F.col("lawyer_id").isNull()).select("id")


@query("WITH " + v.CLINICS + " SELECT id, name FROM clinics WHERE id = 42")
def q_single(spark, d):
    return directory.only(v.clinics(spark, d).select("id", "name"), "id", 42)


@query("WITH " + v.CLINICS + " SELECT id, address FROM clinics WHERE address ILIKE '%, fl %'")
def q_state_ilike(spark, d):
    return v.clinics(spark, d).where(address.in_state(F.col("address"), "fl")).select("id", "address")


@query("WITH " + v.CLINICS + " SELECT id, CASE WHEN contains(address, ', FL ') THEN 'FL' WHEN contains(address, ', MN ') THEN 'MN' ELSE '' END AS state FROM clinics")
def q_state_contains(spark, d):
    return v.clinics(spark, d).select("id", address.state_of(F.col("address")).alias("state"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey = 11")
def q_optional_filters(spark, d):
    rows = v.table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_custkey")
    conditions = [("F", F.col("o_orderstatus") == "F"), (11, F.col("o_custkey") == 11), (None, F.lit(False)), ("urgent", F.lit(False))]
    return directory.where_given(rows, conditions, valid={3: ["low", "high"]}).select("o_orderkey")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-07'")
def q_half_open_range(spark, d):
    ts = F.col("ts")
    return v.table(spark, d, "events", "event_id", "ts").where((ts >= F.lit("2024-01-05").cast("timestamp_ntz")) & (ts < F.lit("2024-01-07").cast("timestamp_ntz"))).select("event_id")


# ---- search and facets


@query("WITH " + v.TAGGED + " SELECT id FROM tagged WHERE contains(lower(name), '42') OR contains(lower(address), '42') OR contains(lower(region), '42') OR contains(lower(county), '42') OR coalesce(len(list_filter(specialties, lambda s: contains(lower(s), '42'))) > 0, false)")
def q_search_map(spark, d):
    return v.tagged_clinics(spark, d).where(directory.contains_any(" 42 ", ["name", "address", "region", "county"], ["specialties"], trim=True)).select("id")


@query("WITH " + v.TAGGED + " SELECT id FROM tagged WHERE contains(lower(concat_ws(' ', nullif(name, ''), nullif(region, ''), nullif(county, ''), array_to_string(specialties, ' '))), 'asia nation')")
def q_search_specialists(spark, d):
    return v.tagged_clinics(spark, d).where(directory.contains_in_all(" Asia Nation", ["name", "region", "county"], "specialties")).select("id")


@query("WITH " + v.CLINICS + " SELECT id FROM clinics WHERE contains(lower(name), '7') OR contains(lower(address), '7') OR contains(lower(region), '7') OR contains(lower(county), '7')")
def q_search_clinics(spark, d):
    return v.clinics(spark, d).where(directory.contains_any("7", ["name", "address", "region", "county"])).select("id")


@query("WITH " + v.FIRMS + " SELECT id FROM firms WHERE contains(lower(name), 'build') OR contains(lower(address), 'build') OR contains(lower(region), 'build') OR contains(lower(county), 'build') OR len(list_filter(practice_areas, lambda s: contains(lower(s), 'build'))) > 0")
def q_search_lawyers(spark, d):
    return v.firms(spark, d).where(directory.contains_any("BUILD", ["name", "address", "region", "county"], ["practice_areas"])).select("id")


@query("SELECT o_orderkey FROM orders WHERE contains(lower(o_orderpriority), 'urgent') AND o_orderstatus = 'O'")
def q_search_referrals(spark, d):
    rows = v.table(spark, d, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus")
    return directory.where_given(rows, [("O", F.col("o_orderstatus") == "O")]).where(directory.contains_any("Urgent", ["o_orderpriority"])).select("o_orderkey")


@query("WITH " + v.FIRMS + ", s AS (SELECT *, CASE WHEN contains(address, ', FL ') THEN 'FL' ELSE 'MN' END AS state FROM firms) SELECT id, name FROM s WHERE state = 'FL' AND (contains(lower(name), '1') OR contains(lower(address), '1')) ORDER BY name, id LIMIT 20")
def q_picker(spark, d):
    rows = v.firms(spark, d).withColumn("state", address.state_of(F.col("address")))
    return directory.picked(rows, "1", ["name", "address"], 20, "FL").select("id", "name")


@query("WITH " + v.TAGGED + " SELECT id FROM tagged WHERE list_contains(specialties, (SELECT min(p_type) FROM part))")
def q_tag_exact(spark, d):
    least = v.table(spark, d, "part", "p_type").agg(F.min("p_type").alias("least"))
    return v.tagged_clinics(spark, d).join(F.broadcast(least), F.array_contains("specialties", F.col("least"))).select("id")


@query("WITH " + v.TAGGED + " SELECT id FROM tagged WHERE specialties IS NULL OR len(specialties) = 0 OR len(list_filter(specialties, lambda s: NOT regexp_matches(s, '(?i)^p'))) > 0")
def q_tag_not_only(spark, d):
    return v.tagged_clinics(spark, d).where(directory.not_only("specialties", "(?i)^p")).select("id")


@query("WITH " + v.TAGGED + """ SELECT id, 'map' AS screen FROM tagged WHERE contains(lower(concat_ws(chr(10), name, address, county, region, array_to_string(specialties, chr(10)))), 'nation_1')
    UNION ALL SELECT id, 'short' FROM tagged WHERE contains(lower(concat_ws(chr(10), name, address, county, region, array_to_string(specialties, chr(10)))), 'ty')""")
def q_indexed_search(spark, d):
    rows, folder = v.tagged_clinics(spark, d), new_path(spark, "trigrams")
    columns, arrays = ["name", "address", "county", "region"], ["specialties"]
    for part in (0, 1):  # two generations
        textindex.add(rows.where(F.col("id") % 2 == part).select("id", *columns, *arrays), folder, textindex.haystack(columns, arrays))
    found = lambda q: textindex.search(spark, folder, q, directory.contains_any(q, columns, arrays))
    return found("NATION_1").select("id", F.lit("map").alias("screen")).unionByName(found("ty").select("id", F.lit("short").alias("screen")))


@query("WITH " + v.TAGGED + " SELECT id FROM tagged WHERE list_has_any(list_transform(specialties, lambda s: lower(s)), ['promo', 'economy'])")
def q_specialist_tags(spark, d):
    return v.tagged_clinics(spark, d).where(directory.matches_specialist("specialties", ["PROMO", "Economy"])).select("id")


@query("WITH " + v.CLINICS + " SELECT DISTINCT region FROM clinics WHERE region <> ''")
def q_facet_region(spark, d):
    return directory.facet(v.clinics(spark, d), "region")


@query("WITH " + v.CLINICS + " SELECT DISTINCT county FROM clinics WHERE county <> '' AND region = (SELECT min(r_name) FROM region)")
def q_facet_county_cascade(spark, d):
    least = v.table(spark, d, "region").agg(F.min("r_name").alias("region"))
    return directory.facet(v.clinics(spark, d).join(F.broadcast(least), "region"), "county")


@query("WITH " + v.TAGGED + " SELECT DISTINCT unnest(specialties) AS specialties FROM tagged")
def q_facet_tags(spark, d):
    return directory.facet(v.tagged_clinics(spark, d), "specialties")


@query("WITH " + v.CLINICS + " SELECT CASE WHEN count(*) > 0 THEN 'NATION_1' ELSE '' END AS choice FROM clinics WHERE county = 'NATION_1' AND region = 'ASIA'")
def q_facet_reset(spark, d):
    return directory.kept_choice(v.clinics(spark, d), "county", "NATION_1", {"region": "ASIA"})


_SCREEN = {"region": [], "county": ["region"], "specialties": ["region", "county"], "available": ["region", "county", "specialties"]}
_CHOICES = {"region": "ASIA", "county": "NATION_1", "specialties": "PROMO"}


@query("WITH " + v.TAGGED + """, t AS (SELECT *, CASE WHEN available THEN 'true' ELSE 'false' END AS free, region = 'ASIA' AS a, county = 'NATION_1' AS b, list_contains(coalesce(specialties, []), 'PROMO') AS c FROM tagged),
    f AS (SELECT 'region' AS facet, region AS value, true AS met FROM t UNION ALL SELECT 'county', county, a FROM t UNION ALL SELECT 'specialties', unnest(specialties), a AND b FROM t UNION ALL SELECT 'available', free, a AND b AND c FROM t),
    n AS (SELECT facet, value, count(*) FILTER (met) AS n FROM f WHERE value <> '' GROUP BY 1, 2), m AS (SELECT *, true AS own FROM (VALUES ('region', 'ASIA'), ('county', 'NATION_1'), ('specialties', 'PROMO')) x(facet, value))
    SELECT facet, value, coalesce(n, 0) AS n, coalesce(own, false) AS chosen, coalesce(own, false) AND coalesce(n, 0) > 0 AS kept FROM n FULL JOIN m USING (facet, value)""")
def q_facet_screen(spark, d):
    return facets.counts(facets.index(v.tagged_clinics(spark, d), list(_SCREEN)), _CHOICES, _SCREEN)


@query("WITH " + v.CLINICS + " SELECT count(*) AS total, count(*) FILTER (available) AS available, count(*) - count(*) FILTER (available) AS unavailable, count(DISTINCT region) AS regions FROM clinics")
def q_availability_stats(spark, d):
    counts = v.clinics(spark, d).agg(F.count("*").alias("total"), F.count_if("available").alias("available"), F.count_distinct("region").alias("regions"))
    return counts.withColumn("unavailable", F.col("total") - F.col("available"))


@query("WITH " + v.CLINICS + " SELECT id FROM clinics WHERE NOT available")
def q_unavailable(spark, d):
    return v.clinics(spark, d).where(directory.is_available("unavailable")).select("id")


_MAP = "WITH " + v.CLINICS + ", " + v.FIRMS + ", places AS (SELECT 'clinic' AS kind, id, name, lat, lng FROM clinics WHERE lat <> 0 AND lng <> 0 UNION ALL SELECT 'lawyer', id, name, lat, lng FROM firms WHERE lat <> 0 AND lng <> 0)"


def _places(spark, d):
    return directory.on_map(v.clinics(spark, d).select("id", "name", "lat", "lng"), v.firms(spark, d).select("id", "name", "lat", "lng"))


@query(_MAP + " SELECT kind, id, name, lat, lng FROM places")
def q_map_union(spark, d):
    return _places(spark, d).select("kind", "id", "name", "lat", "lng")


_MILES = "round(2 * 3958.8 * atan2(sqrt(pow(sin(radians(lat - 27.8) / 2), 2) + cos(radians(27.8)) * cos(radians(lat)) * pow(sin(radians(lng + 83.5) / 2), 2)), sqrt(1 - (pow(sin(radians(lat - 27.8) / 2), 2) + cos(radians(27.8)) * cos(radians(lat)) * pow(sin(radians(lng + 83.5) / 2), 2)))), 6)"


@query(_MAP + f" SELECT kind, id, {_MILES} AS miles FROM places ORDER BY miles, kind, id LIMIT 20")
def q_nearest20(spark, d):
    return directory.nearest(_places(spark, d), 27.8, -83.5, 20).select("kind", "id", "miles")


@query()  # a greedy rule has no SQL: tests compare it with a plain run
def q_map_clusters(spark, d):
    return clustering.screen_clusters(_places(spark, d), 6, 8).select("kind", "id", "places", "clinics", "lawyers", "size")


_EACH = "round(2 * 3958.8 * atan2(sqrt(h), sqrt(1 - h)), 6)"


@query(_MAP + f""", pairs AS (SELECT c_custkey AS point, kind, id, pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lng - plng) / 2), 2) AS h
        FROM (SELECT c_custkey, 24 + CAST(c_custkey % 800 AS DOUBLE) / 97 AS plat, -88 + CAST(c_custkey % 900 AS DOUBLE) / 89 AS plng FROM customer), places WHERE kind = 'clinic'),
    r AS (SELECT point, id, {_EACH} AS miles, CAST(row_number() OVER (PARTITION BY point ORDER BY {_EACH}, id) AS INTEGER) AS nth FROM pairs) SELECT point, nth, id, miles FROM r WHERE nth <= 3""")
def q_nearest_to_each(spark, d):
    k = F.col("c_custkey")
    points = v.table(spark, d, "customer", "c_custkey").select(k.alias("point"), (24 + (k % 800).cast("double") / 97).alias("lat"), (-88 + (k % 900).cast("double") / 89).alias("lng"))
    return nearby.nearest_to_each(points, v.clinics(spark, d).select("id", "lat", "lng"), 3).select("point", "nth", "id", "miles")


@query(_MAP + " SELECT count(*) AS places, count(*) FILTER (kind = 'clinic') AS clinics, count(*) FILTER (kind = 'lawyer') AS lawyers FROM places")
def q_type_counts(spark, d):
    return _places(spark, d).agg(F.count("*").alias("places"), F.count_if(F.col("kind") == "clinic").alias("clinics"), F.count_if(F.col("kind") == "lawyer").alias("lawyers"))


@query("WITH " + v.CLINICS + " SELECT id FROM clinics WHERE CASE WHEN id % 3 = 0 THEN 0 ELSE lat END <> 0 AND lng <> 0")
def q_valid_coords(spark, d):
    return v.clinics(spark, d).withColumn("lat", F.when(F.col("id") % 3 != 0, F.col("lat"))).where(geo.has_coordinates(F.col("lat"), F.col("lng"))).select("id")


@query(_MAP + ", c AS (SELECT CAST(floor(lat / 1.5) AS BIGINT) AS \"row\", CAST(floor(lng / 1.5) AS BIGINT) AS \"column\", count(*) AS places, count(*) FILTER (kind = 'clinic') AS clinics, count(*) FILTER (kind = 'lawyer') AS lawyers FROM places GROUP BY 1, 2) SELECT *, CASE WHEN places < 20 THEN 'small' WHEN places < 100 THEN 'medium' ELSE 'large' END AS size FROM c")
def ext_map_clusters(spark, d):
    return directory.clusters(_places(spark, d), 1.5)


@query("SELECT DISTINCT CASE WHEN s_suppkey % 3 = 0 THEN 'FL' WHEN s_suppkey % 3 = 1 THEN 'MN' ELSE 'XX' END AS state, CASE s_suppkey % 3 WHEN 0 THEN 27.8::DOUBLE WHEN 1 THEN 46.0::DOUBLE ELSE 39.8::DOUBLE END AS lat, CASE s_suppkey % 3 WHEN 2 THEN 5 ELSE 7 END AS zoom FROM supplier")
def q_state_view(spark, d):
    k = F.col("s_suppkey") % 3
    rows = v.table(spark, d, "supplier", "s_suppkey").select(F.when(k == 0, "FL").when(k == 1, "MN").otherwise("XX").alias("state")).distinct()
    return rows.withColumn("v", geo.view(F.col("state"))).select("state", "v.lat", "v.zoom")


@query("WITH " + v.CLINICS + " SELECT region, county, count(*) AS n, array_to_string(list_sort(list(name))[1:5], '; ') AS shown, greatest(count(*) - 5, 0) AS more FROM clinics GROUP BY region, county")
def q_region_tree(spark, d):
    return directory.tree(v.clinics(spark, d), "region", "county", "name")


# ---- activity log


@query("""WITH l AS (SELECT event_id, event_type, row_number() OVER (ORDER BY ts DESC, event_id) AS nth, count(*) OVER () AS total FROM events WHERE event_type = 'click')
    SELECT event_id, event_type, nth, total, CAST(ceil(total / 50) AS BIGINT) AS pages FROM l WHERE nth BETWEEN 51 AND 100""")
def q_log_page2(spark, d):
    rows = directory.where_given(v.table(spark, d, "events", "event_id", "event_type", "ts"), [("click", F.col("event_type") == "click"), (None, F.lit(False))])
    return referrals.page(rows, [F.desc("ts"), F.col("event_id")], 2, 50).drop("ts")


@query("""WITH l AS (SELECT event_id, event_type, row_number() OVER (ORDER BY ts DESC, event_id) AS nth, count(*) OVER () AS total FROM events)
    SELECT event_id, event_type, nth, total, CAST(ceil(total / 40) AS BIGINT) AS pages FROM l WHERE nth BETWEEN 201 * 40 + 1 AND 202 * 40""")
def q_deep_page(spark, d):
    folder = new_path(spark, "log")
    pages.arrange(v.table(spark, d, "events", "event_id", "event_type", "ts"), {"ts": False, "event_id": True}, folder, block=4096)
    return pages.page(spark, folder, 202, 40).drop("ts")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-11 23:59:59.999'")
def q_log_day_range(spark, d):
    rows = v.table(spark, d, "events", "event_id", "ts")
    return rows.where((F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")) & (F.col("ts") <= dates.end_of_day("2024-01-11").cast("timestamp_ntz"))).select("event_id")


@query("SELECT event_id, concat('k: ', json_extract_string(props, '$.k')) AS details FROM events")
def q_log_details(spark, d):
    return v.table(spark, d, "events", "event_id", "props").select("event_id", text.details_text(F.col("props")).alias("details"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'Clicked' WHEN 'view' THEN 'Viewed' ELSE event_type END AS label FROM events")
def q_labels(spark, d):
    return v.table(spark, d, "events", "event_id", "event_type").select("event_id", text.lookup(F.col("event_type"), {"click": "Clicked", "view": "Viewed"}).alias("label"))


@query("SELECT string_agg(concat(key, '=', value), ',' ORDER BY key) AS settings FROM (SELECT event_type AS key, CAST(count(*) AS VARCHAR) AS value FROM events GROUP BY event_type)")
def q_settings_map(spark, d):
    rows = v.table(spark, d, "events", "event_type").groupBy(F.col("event_type").alias("key")).agg(F.count("*").cast("string").alias("value"))
    pairs = F.transform(F.array_sort(F.map_entries("settings")), lambda e: F.concat(e.key, F.lit("="), e.value))
    return referrals.settings_object(rows, "key", "value").select(F.array_join(pairs, ",").alias("settings"))


@query("SELECT date_trunc('day', ts) AS start, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2")
def ext_activity_windows(spark, d):
    return activity.windowed(v.table(spark, d, "events", "ts", "event_type"), "ts", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))


# ---- joins


@query("SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def q_lookup_join(spark, d):
    named = v.table(spark, d, "customer", "c_custkey", "c_name", "c_nationkey").join(F.broadcast(v.table(spark, d, "nation", "n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return v.table(spark, d, "orders", "o_orderkey", "o_custkey").join(named, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name", "n_name")


@query("WITH " + v.CLINICS + ", " + v.USERS + " SELECT clinics.id AS clinic, users.id AS user_id FROM clinics JOIN users ON users.clinic_id = clinics.id AND role = 'clinic'")
def q_one_to_many(spark, d):
    people = v.users(spark, d).where("role = 'clinic'").select(F.col("id").alias("user_id"), F.col("clinic_id").alias("clinic"))
    return v.clinics(spark, d).select(F.col("id").alias("clinic")).join(people, "clinic")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def q_semi_exists(spark, d):
    done = v.table(spark, d, "orders", "o_custkey", "o_orderstatus").where("o_orderstatus = 'F'")
    return v.table(spark, d, "customer", "c_custkey").join(done, F.col("o_custkey") == F.col("c_custkey"), "left_semi")


@query("WITH " + v.REFERRALS + " SELECT id FROM referrals LEFT JOIN customer ON lawyer_id = c_custkey AND c_acctbal >= 0 WHERE c_custkey IS NULL")
def q_orphans_compat(spark, d):
    return resolve.orphans(v.referrals(spark, d), "lawyer_id", v.table(spark, d, "customer", "c_custkey", "c_acctbal").where("c_acctbal >= 0"), "c_custkey").select("id")


@query("WITH " + v.REFERRALS + " SELECT id FROM referrals LEFT JOIN customer ON lawyer_id = c_custkey AND c_acctbal >= 0 WHERE c_custkey IS NULL AND lawyer_id IS NOT NULL")
def q_orphans_strict(spark, d):
    return resolve.orphans(v.referrals(spark, d), "lawyer_id", v.table(spark, d, "customer", "c_custkey", "c_acctbal").where("c_acctbal >= 0"), "c_custkey", strict=True).select("id")


@query("WITH " + v.USERS + ", " + v.FIRMS + " SELECT users.id, firms.id AS firm FROM users LEFT JOIN firms ON lower(users.email) = lower(firms.email)")
def q_ci_key_join(spark, d):
    right = v.firms(spark, d).select(F.col("id").alias("firm"), "email")
    return resolve.ignoring_case(v.users(spark, d).select("id", "email"), right, "email", "firm").select("id", "firm")


@query("WITH " + v.USERS + ", " + v.CLINICS + ", p AS (SELECT users.id, clinics.id AS match_id, row_number() OVER (PARTITION BY users.id ORDER BY clinics.name, clinics.id) AS nth FROM users JOIN clinics ON split_part(lower(users.email), '@', 2) = split_part(lower(clinics.email), '@', 2)) SELECT id, match_id FROM p WHERE nth <= 5")
def q_domain_join_top5(spark, d):
    return resolve.by_domain(v.users(spark, d), v.clinics(spark, d)).select("id", "match_id")


@query("WITH " + v.USERS + ", " + v.FIRMS + ", p AS (SELECT users.id, firms.id AS match_id, row_number() OVER (PARTITION BY users.id ORDER BY firms.name, firms.id) AS nth FROM users JOIN firms ON firms.address ILIKE concat('%, ', state, ' %')) SELECT id, match_id, CAST(nth AS INTEGER) AS nth FROM p WHERE nth <= 15")
def q_state_join_top15(spark, d):
    places = v.firms(spark, d).withColumn("state", address.state_of(F.col("address")))
    return resolve.by_state(v.users(spark, d), places).select("id", "match_id", "nth")


@query("WITH c AS (SELECT p_name, count(*) AS n FROM part GROUP BY p_name) SELECT p_partkey, CASE WHEN n = 1 AND p_size > 25 THEN 'checked' ELSE p_brand END AS p_brand FROM part JOIN c USING (p_name)")
def q_unique_match_only(spark, d):
    parts = v.table(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_size")
    patches = parts.where("p_size > 25").select("p_name", F.lit("checked").alias("new_brand")).distinct()
    return resolve.matched_once(parts, patches, "p_name", {"p_brand": "new_brand"}).select("p_partkey", "p_brand")


# ---- aggregates


@query("WITH " + v.TAGGED + " SELECT tag, count(*) AS n FROM (SELECT unnest(specialties) AS tag FROM tagged) GROUP BY tag")
def q_unnest_count(spark, d):
    return v.tagged_clinics(spark, d).select(F.explode("specialties").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("SELECT coalesce(nullif(CASE WHEN p_size % 5 = 0 THEN '' ELSE p_type END, ''), 'Unknown') AS bucket, count(*) AS n FROM part GROUP BY 1")
def q_default_bucket(spark, d):
    kind = F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_type"))
    return v.table(spark, d, "part", "p_size", "p_type").groupBy(text.or_else(kind, "Unknown").alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_type)), '|') AS tags, arg_min(p_name, p_partkey) AS p_name FROM part GROUP BY p_brand")
def q_merge_tags(spark, d):
    return resolve.merged_tags(v.table(spark, d, "part"), ["p_brand"], "p_type", "p_partkey", ["p_name"]).withColumn("tags", F.array_join("tags", "|"))


@query("SELECT bool_and(s_acctbal > -2000) AS \"all\", bool_or(s_acctbal < 0) AS \"any\", CAST(sum(len(split(s_name, '#'))) AS BIGINT) AS parts FROM supplier")
def q_reductions(spark, d):
    return v.table(spark, d, "supplier").agg(F.bool_and(F.col("s_acctbal") > -2000).alias("all"), F.bool_or(F.col("s_acctbal") < 0).alias("any"), F.sum(F.size(F.split("s_name", "#"))).cast("long").alias("parts"))


@query("WITH r AS (SELECT event_type AS category, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_type, event_id) AS nth FROM events) SELECT category, count(*) AS \"rows\", count(*) FILTER (nth = 1) AS new FROM r GROUP BY category")
def q_file_tallies(spark, d):
    rows = v.table(spark, d, "events", "event_id", "event_type", "user_id").select(F.col("event_type").alias("category"), F.col("event_type").alias("file"), F.col("event_id").alias("line"), "user_id")
    return listings.tallies(rows, ["user_id"], "category")


# ---- matching


@query(r"WITH k AS (SELECT doc_id, source, regexp_replace(lower(text), '\s+', ' ', 'g') AS key FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS nth FROM k) SELECT doc_id, source FROM r WHERE nth = 1")
def q_first_wins_dedup(spark, d):
    key = F.sha2(F.regexp_replace(F.lower("text"), r"\s+", " "), 256)  # a digest: whole texts are not shuffled
    rows = v.table(spark, d, "documents", "doc_id", "source", "text").select("doc_id", "source", key.alias("key"))
    return resolve.first_wins(rows, [F.col("key")], [F.col("doc_id")]).select("doc_id", "source")


@query("SELECT doc_id FROM documents WHERE concat(lang, '|', source) NOT IN (SELECT concat(lang, '|', source) FROM documents JOIN labels USING (doc_id) WHERE quality = 0)")
def q_new_vs_existing(spark, d):
    rows = v.table(spark, d, "documents", "doc_id", "lang", "source").withColumn("key", F.concat_ws("|", "lang", "source"))
    poor = rows.join(v.table(spark, d, "labels").where("quality = 0"), "doc_id")
    return resolve.unknown(rows, poor, ["key"]).select("doc_id")


@query("""WITH u AS (SELECT c_custkey AS id, concat('new ', c_custkey) AS name, 0.0::DOUBLE AS balance FROM customer WHERE c_custkey BETWEEN 40 AND 60 UNION ALL SELECT -1, 'added', 1.0)
    SELECT c_custkey AS id, CASE WHEN c_custkey % 50 = 7 THEN 'patched' ELSE c_name END AS name, c_acctbal AS balance FROM customer WHERE c_custkey NOT BETWEEN 40 AND 60 AND c_custkey NOT BETWEEN 100 AND 119
    UNION ALL SELECT id, CASE WHEN id % 50 = 7 THEN 'patched' ELSE name END, balance FROM u""")
def q_versioned_writes(spark, d):
    rows, folder = v.table(spark, d, "customer", "c_custkey", "c_name", "c_acctbal").toDF("id", "name", "balance"), new_path(spark, "customers")
    k = F.col("id")
    versions.create(rows, folder, "id", file_rows=1 << 16)
    changed = rows.where(k.between(40, 60)).select("id", F.concat(F.lit("new "), k.cast("string")).alias("name"), F.lit(0.0).alias("balance"))
    added = spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit("added").alias("name"), F.lit(1.0).alias("balance"))
    for _ in range(2):  # a rerun changes nothing
        versions.upsert(spark, folder, changed.unionByName(added), token="upsert")
    versions.delete(spark, folder, rows.where(k.between(100, 119)).select("id"))
    versions.patch(spark, folder, rows.where(k % 50 == 7).select("id", F.lit("patched").alias("name")), ["name"])
    return versions.read(spark, folder)


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'F' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 11 <> 0) GROUP BY 1, 2")
def q_maintained_counts(spark, d):
    rows, folder = v.table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority").toDF("id", "status", "priority"), new_path(spark, "counts")
    k, groups = F.col("id"), ["status", "priority"]
    moved = rows.withColumn("status", F.when(k % 7 == 0, "F").otherwise(F.col("status")))
    states = [rows.where(k % 2 == 0), rows, moved, moved.where(k % 11 != 0)]  # inserts, updates, deletes
    maintained.start(spark, folder, states[0], groups)
    for n, (old, new) in enumerate(zip(states, states[1:], strict=False)):
        for _ in range(2):  # a replay changes nothing
            maintained.apply(spark, folder, maintained.changes(old, new, "id"), groups, f"batch-{n}")
    return maintained.counts(spark, folder)


_TOKENS = "list_filter(string_split_regex(regexp_replace(lower(firm_name), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: len(w) > 2 AND w NOT IN ('law', 'firm', 'group', 'and', 'the', 'associates', 'legal'))"


@query("WITH " + v.USERS + f", w AS (SELECT DISTINCT id, unnest({_TOKENS}) AS token FROM users), hits AS (SELECT token, p_partkey, p_type, row_number() OVER (PARTITION BY token ORDER BY p_type, p_partkey) AS nth FROM (SELECT DISTINCT token FROM w) JOIN part ON contains(lower(concat(p_type, ' ', 'machinery household')), token)) SELECT DISTINCT id, p_partkey AS match_id FROM w JOIN hits USING (token) WHERE nth <= 10")
def q_token_match(spark, d):
    parts = v.table(spark, d, "part", "p_partkey", "p_type").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("kind"))
    named = parts.withColumn("name", F.concat("kind", F.lit(" machinery household")))
    return resolve.by_token(v.users(spark, d), named, "firm_name", "name").select("id", "match_id")


# The four rules for two addresses of one place, as SQL: forms of an address, then every pair of addresses.
_FORMS = [
    (r"\b(suite|ste|unit|building)\b\s*\S*", ""), (r"(\w)#\s*\S*", r"\1"), (",", " "), (r"\s+", " "), (r"^\s+|\s+$", ""), (r"\bmartin luther king jr\b", "mlk jr"), (r"\bmartin luther king\b", "mlk"),
    *[(rf"\b{c}\.?\s*", f"{c} ") for c in ("n", "s", "e", "w", "nw", "ne", "sw", "se")], *[(rf"\b{a}\.\s", f"{a} ") for a in ("st", "ave", "blvd", "dr", "rd", "hwy", "pkwy")], (r"\(hq\)\s*", ""), (r"\s+", " "), (r"^\s+|\s+$", ""),
]


def _forms_sql(rows: str) -> str:
    core = r"regexp_replace(regexp_replace(trim(lower(address)), '\s+', ' ', 'g'), ',\s*fl\b.*$', '')"
    for pattern, into in _FORMS:
        core = f"regexp_replace({core}, '{pattern}', '{into}', 'g')"
    named, before = r"regexp_extract(trim(lower(address)), ',\s*([^,]+?)\s*,\s*fl\b', 1)", r"regexp_replace(trim(lower(address)), ',\s*fl\b.*$', '')"
    city = f"CASE WHEN {named} <> '' THEN {named} WHEN contains({before}, ',') THEN trim(regexp_extract({before}, '([^,]*)$', 1)) ELSE '' END"
    forms = f"SELECT id, {core} AS core, {city} AS city, regexp_extract(address, '^\\(?\\w*\\)?\\s*([0-9]+)', 1) AS number FROM {rows}"
    return rf"SELECT *, regexp_extract(regexp_replace(core, '^[0-9]+\s*', ''), '^\S*') AS word FROM ({forms})"


_SPELLINGS = [  # of an address: a number, a street, a city
    ("{n}  N. Oak St., Suite 4, {c}, FL 33101", "{n} n oak st {c}, FL"), ("{n} Martin Luther King Jr Blvd. , {c}, FL", "{n} MLK Jr Blvd Unit B, {c} , FL"), ("Building 7 {n} W Elm Ave., {c}, FL", "{n} w. elm ave #12, {c}, FL 33102"),
    ("(HQ) {n} Pine Hwy. , {c}, FL", "1{n} Pine Hwy, {c}, FL"), ("{n} Oak, {c}", "Oak, {c}, FL"), ("Near Main Mall, {c}, FL", "{n} Ste. Marie Road, {c}, FL"),
]


def _spelt(side: int, key: str) -> Column:
    """The address of a key on one side (new or existing)."""
    k = F.col(key)
    n, c = (F.floor(k / 6) % 90 + 1).cast("string"), F.concat(F.lit("CITY"), (F.floor(k / 3) % 25).cast("string"))
    told = F.element_at(F.array(*[F.lit(x[side]) for x in _SPELLINGS]), (k % 6 + 1).cast("int"))
    return F.replace(F.replace(told, F.lit("{n}"), n), F.lit("{c}"), c)


def _spelt_sql(side: int, key: str) -> str:
    told = f"[{', '.join(repr(x[side]) for x in _SPELLINGS)}][{key} % 6 + 1]"
    return f"replace(replace({told}, '{{n}}', CAST({key} // 6 % 90 + 1 AS VARCHAR)), '{{c}}', concat('CITY', {key} // 3 % 25))"


@query(f"""WITH n AS ({_forms_sql(f"(SELECT s_suppkey AS id, {_spelt_sql(0, 's_suppkey')} AS address FROM supplier)")}), e AS ({_forms_sql(f"(SELECT c_custkey AS id, {_spelt_sql(1, 'c_custkey')} AS address FROM customer)")})
    SELECT n.id, min(e.id) AS match_id FROM n LEFT JOIN e ON n.core = e.core OR (n.city = e.city AND n.city <> '' AND ((n.core <> '' AND e.core <> '' AND (contains(n.core, e.core) OR contains(e.core, n.core))) OR (n.number = e.number AND n.number <> '' AND n.word = e.word AND n.word <> ''))) GROUP BY n.id""")
def q_fuzzy_address(spark, d):
    new = v.table(spark, d, "supplier", "s_suppkey").select(F.col("s_suppkey").alias("id"), _spelt(0, "s_suppkey").alias("address"))
    existing = v.table(spark, d, "customer", "c_custkey").select(F.col("c_custkey").alias("id"), _spelt(1, "c_custkey").alias("address"), F.col("c_custkey").alias("place"))
    return resolve.by_address(new, existing).select("id", "match_id")


# ---- text


@query(r"SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '^[\s]+|[\s]+$', '', 'g') AS clean FROM pages")
def q_sanitize(spark, d):
    return v.table(spark, d, "pages", "page_id", "html").select("page_id", text.without_tags(F.col("html")).alias("clean"))


@query("SELECT page_id, replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped, url_encode(url) AS encoded FROM pages")
def q_escape(spark, d):
    return v.table(spark, d, "pages", "page_id", "url").select("page_id", text.html_escaped(F.col("url")).alias("escaped"), text.url_component(F.col("url")).alias("encoded"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[.,;:''"()\-]', '', 'g'), '\s+', ' ', 'g')) AS form FROM documents""")
def q_norm_text(spark, d):
    return v.table(spark, d, "documents", "doc_id", "text").select("doc_id", text.matching_form(F.col("text")).alias("form"))


@query("WITH " + v.FIRMS + r""" SELECT id, CASE WHEN NOT (length(name) BETWEEN 2 AND 18) THEN 'name' WHEN NOT regexp_full_match(phone, '[+\d\s().-]{7,20}') THEN 'phone' WHEN NOT regexp_full_match(CASE WHEN id % 7 = 0 THEN 'bad' ELSE email END, '[^\s@]+@[^\s@]+\.[^\s@]+') THEN 'email' END AS error,
    length(regexp_replace(phone, '[^0-9]', '', 'g')) BETWEEN 7 AND 15 AS digits FROM firms""")
def q_validate_contacts(spark, d):
    rows = v.firms(spark, d).withColumn("email", F.when(F.col("id") % 7 == 0, "bad").otherwise(F.col("email")))
    checks = [(contact.has_length(F.col("name"), 2, 18), "name"), (contact.is_phone(F.col("phone")), "phone"), (contact.is_email(F.col("email")), "email")]
    return rows.select("id", contact.first_error(checks).alias("error"), contact.has_phone_digits(F.col("phone")).alias("digits"))


_RULES = [("(?i)promo", ["Sale"]), ("(?i)economy|small", ["Budget", "Basics"]), ("(?i)standard", ["Basics"])]


@query("""WITH l AS (SELECT p_partkey, list_concat(list_concat(CASE WHEN regexp_matches(p_type, '(?i)promo') THEN ['Sale'] ELSE [] END, CASE WHEN regexp_matches(p_type, '(?i)economy|small') THEN ['Budget', 'Basics'] ELSE [] END), CASE WHEN regexp_matches(p_type, '(?i)standard') THEN ['Basics'] ELSE [] END) AS labels FROM part)
    SELECT p_partkey, CASE WHEN len(labels) = 0 THEN 'General' ELSE array_to_string(labels, '|') END AS labels FROM l""")
def q_classify_multilabel(spark, d):
    return v.table(spark, d, "part", "p_partkey", "p_type").select("p_partkey", F.array_join(resolve.labelled(F.col("p_type"), _RULES, "General"), "|").alias("labels"))


@query("SELECT n_nationkey, coalesce(r_name, 'Elsewhere') AS region FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey <> 2")
def q_county_region(spark, d):
    nation, region = v.table(spark, d, "nation"), v.table(spark, d, "region").where("r_regionkey <> 2")
    pairs = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("county"), F.col("r_name").alias("region"))
    return resolve.with_region(nation, "n_name", F.broadcast(pairs), "Elsewhere").select("n_nationkey", "region")


@query("WITH n AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipdate, CAST(row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity) AS VARCHAR) AS nth FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipdate, concat('c-', CASE WHEN length(nth) < 3 THEN lpad(nth, 3, '0') ELSE nth END) AS id FROM n")
def q_ids_padded(spark, d):
    rows = v.table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate")
    return listings.with_ids(rows, "c-", [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")])


@query("SELECT max(c_custkey) AS last FROM customer")
def q_max_suffix(spark, d):
    ids = v.table(spark, d, "customer", "c_custkey").select(text.padded_id(F.col("c_custkey"), "c-").alias("id"))
    return ids.agg(F.max(text.suffix_number(F.col("id"), "c-")).alias("last"))


@query("SELECT p_partkey, upper(array_to_string(list_transform(list_filter(string_split_regex(trim(p_name), '\\s+'), lambda w: w <> '')[1:2], lambda w: w[1:1]), '')) AS initials FROM part")
def q_initials(spark, d):
    return v.table(spark, d, "part", "p_partkey", "p_name").select("p_partkey", text.initials(F.col("p_name")).alias("initials"))


@query("SELECT doc_id, CASE WHEN length(text) > 40 THEN concat(substr(text, 1, 40), '...') ELSE text END AS short FROM documents")
def q_truncate(spark, d):
    return v.table(spark, d, "documents", "doc_id", "text").select("doc_id", text.truncated(F.col("text"), 40).alias("short"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey >= 1000 THEN concat(CAST(floor(o_orderkey / 1000 + 0.5) AS BIGINT), 'K') ELSE CAST(o_orderkey AS VARCHAR) END AS short FROM orders")
def q_abbrev(spark, d):
    return v.table(spark, d, "orders", "o_orderkey").select("o_orderkey", text.short_number(F.col("o_orderkey")).alias("short"))


@query("WITH " + v.TAGGED + " SELECT id, concat(array_to_string(specialties[1:3], ', '), CASE WHEN len(specialties) > 3 THEN concat(' +', len(specialties) - 3, ' more') ELSE '' END) AS shown FROM tagged WHERE specialties IS NOT NULL")
def q_array_prefix(spark, d):
    return v.tagged_clinics(spark, d).where(F.col("specialties").isNotNull()).select("id", text.first_and_more(F.col("specialties"), 3).alias("shown"))


@query("WITH " + v.CLINICS + " SELECT id, array_to_string(list_filter(list_transform(split(address, ','), lambda x: trim(x)), lambda x: x <> ''), ';') AS parts, array_to_string(split(address, ',')[1:2], ',') AS head FROM clinics")
def q_split_list(spark, d):
    return v.clinics(spark, d).select("id", F.array_join(text.listed(F.col("address")), ";").alias("parts"), text.first_parts(F.col("address"), 2).alias("head"))


@query("""WITH a AS (SELECT event_id, ts, CAST(floor((epoch(TIMESTAMP '2024-01-31') - floor(epoch(ts))) / 60) AS BIGINT) AS m FROM events)
    SELECT event_id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN concat(m, 'm ago') WHEN m < 1440 THEN concat(CAST(floor(m / 60) AS BIGINT), 'h ago') WHEN m < 10080 THEN concat(CAST(floor(m / 1440) AS BIGINT), 'd ago') ELSE strftime(ts, '%Y-%m-%d') END AS age FROM a""")
def q_time_ago(spark, d):
    ts = F.col("ts").cast("timestamp")
    return v.table(spark, d, "events", "event_id", "ts").select("event_id", dates.age(ts, F.lit("2024-01-31").cast("timestamp")).alias("age"))


# the same events half a year on are in summer time, one hour less away from UTC (from the second Sunday in March on)
@query("""WITH e AS (SELECT event_id, ts FROM events UNION ALL SELECT -1 - event_id, ts + INTERVAL 182 DAY FROM events)
    SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%b %-d, %Y') AS short, strftime(ts - to_hours(CASE WHEN ts >= TIMESTAMP '2024-03-10 07:00:00' AND ts < TIMESTAMP '2024-11-03 06:00:00' THEN 4 ELSE 5 END), '%B %-d, %Y at %I:%M %p') AS zoned FROM e""")
def q_date_formats(spark, d):
    rows = v.table(spark, d, "events", "event_id", "ts").withColumn("ts", F.col("ts").cast("timestamp"))
    later = rows.select((-1 - F.col("event_id")).alias("event_id"), (F.col("ts") + F.expr("interval 182 days")).alias("ts"))
    ts = F.col("ts")
    return rows.unionByName(later).select("event_id", dates.iso_day(ts).alias("day"), dates.short_date(ts).alias("short"), dates.zoned_date(ts).alias("zoned"))


@query("WITH " + v.CLINICS + " SELECT id, NOT regexp_matches(split_part(CASE WHEN id % 5 = 0 THEN concat('Main St', substr(address, position(',' IN address))) ELSE address END, ',', 1), '[0-9]') AS vague FROM clinics")
def q_vague_address(spark, d):
    a = F.when(F.col("id") % 5 == 0, F.concat(F.lit("Main St"), F.col("address").substr(F.locate(",", "address"), F.length("address")))).otherwise(F.col("address"))
    return v.clinics(spark, d).select("id", address.is_vague(a).alias("vague"))


# ---- changes of state


@query("SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN concat(c_name, ' (new)') ELSE c_name END AS name FROM customer UNION ALL SELECT -1 - c_custkey, 'added' FROM customer WHERE c_acctbal < 0")
def q_upsert(spark, d):
    rows = v.table(spark, d, "customer", "c_custkey", "c_name", "c_acctbal").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "c_acctbal")
    some = rows.where("c_acctbal < 0")
    new = some.select("id", F.concat("name", F.lit(" (new)")).alias("name")).unionByName(some.select((-1 - F.col("id")).alias("id"), F.lit("added").alias("name")))
    return mutate.upserted(rows.select("id", "name"), new, "id")


@query("SELECT o_orderkey AS id, CASE WHEN o_totalprice > 300000 THEN 'F' ELSE o_orderstatus END AS status, CASE WHEN o_totalprice > 300000 THEN TIMESTAMP '2001-08-01' ELSE o_orderdate END AS updated_at FROM orders")
def q_patch(spark, d):
    base = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("updated_at"), "o_totalprice")
    patches = base.where("o_totalprice > 300000").select("id", F.lit("F").alias("status"))
    return mutate.patched(base.drop("o_totalprice"), patches, "id", ["status"], touched="updated_at", now=f"{NOW} 00:00:00")


@query("WITH " + v.CLINICS + " SELECT id, CASE WHEN id IN (3, 4, 5, 60) THEN false ELSE available END AS available FROM clinics")
def q_bulk_toggle(spark, d):
    return mutate.set_where(v.clinics(spark, d).select("id", "available"), F.col("id").isin(3, 4, 5, 60), {"available": F.lit(False)})


@query("SELECT c_custkey FROM customer WHERE NOT (c_acctbal < 0 AND c_custkey <> 12)")
def q_bulk_delete(spark, d):
    rows = v.table(spark, d, "customer", "c_custkey", "c_acctbal")
    return mutate.deleted_ids(rows.select("c_custkey"), "c_custkey", rows.where("c_acctbal < 0"), never=12)[0]


@query("SELECT count(*) AS deleted FROM customer WHERE c_acctbal < 0 AND c_custkey <> 12")
def q_bulk_delete_count(spark, d):
    rows = v.table(spark, d, "customer", "c_custkey", "c_acctbal")
    return mutate.deleted_ids(rows.select("c_custkey"), "c_custkey", rows.where("c_acctbal < 0"), never=12)[1]


@query("WITH " + v.USERS + " SELECT id FROM users WHERE role = 'lawyer'")
def q_delete_except(spark, d):
    return mutate.deleted(v.users(spark, d), F.col("role") != "lawyer").select("id")


@query("WITH " + v.USERS + ", " + v.FIRMS + " SELECT users.id, coalesce(users.lawyer_id, firms.id) AS lawyer_id FROM users LEFT JOIN firms ON lower(users.email) = lower(firms.email)")
def q_backfill_ci(spark, d):
    return mutate.backfilled(v.users(spark, d), v.firms(spark, d), "lawyer_id", "email", "id").select("id", "lawyer_id")


@query("WITH " + v.USERS + " SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM users WHERE lawyer_id = o_custkey) THEN 'linked' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def q_backfill_exists(spark, d):
    linked = v.users(spark, d).select(F.col("lawyer_id").alias("o_custkey"))
    return mutate.set_where_exists(v.table(spark, d, "orders"), linked, "o_custkey", "o_orderstatus", F.lit("linked")).select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, CAST(c_custkey AS VARCHAR) AS o_custkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal >= 0")
def q_set_null(spark, d):
    alive = v.table(spark, d, "customer", "c_custkey", "c_acctbal").where("c_acctbal >= 0")
    return mutate.references_cleared(v.table(spark, d, "orders", "o_orderkey", "o_custkey"), "o_custkey", alive, "c_custkey").withColumn("o_custkey", F.col("o_custkey").cast("string"))


@query("SELECT DISTINCT c_custkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal < 0")
def q_restrict(spark, d):
    going = v.table(spark, d, "customer", "c_custkey", "c_acctbal").where("c_acctbal < 0")
    return mutate.still_referenced(going.select("c_custkey"), "c_custkey", v.table(spark, d, "orders", "o_custkey"), "o_custkey")


@query("SELECT s_suppkey, s_name, CAST(NULL AS VARCHAR) AS zip_code FROM supplier UNION ALL SELECT -1, 'Unnamed', NULL")
def q_insert_defaults(spark, d):
    rows = mutate.widened(v.table(spark, d, "supplier", "s_suppkey", "s_name"), {"zip_code": "string"})
    new = spark.range(1).select(F.lit(-1).cast("long").alias("s_suppkey"), F.lit("").alias("s_name"))
    return mutate.inserted(rows, new, {"s_name": "Unnamed"})


@query("SELECT o_orderkey, o_totalprice, o_orderpriority, CAST(floor((row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1) / 200) + 1 AS BIGINT) AS batch FROM orders")
def q_batches(spark, d):
    return mutate.batches(v.table(spark, d, "orders", "o_orderkey", "o_totalprice", "o_orderpriority"), [F.desc("o_totalprice"), F.col("o_orderkey")], 200)


@query("WITH " + v.CLINICS + ", " + v.USERS + " SELECT DISTINCT id, email FROM (SELECT id, email FROM clinics UNION ALL SELECT clinics.id, users.email FROM clinics JOIN users ON users.clinic_id = clinics.id) WHERE email <> ''")
def q_recipients(spark, d):
    return referrals.recipients(v.clinics(spark, d), v.users(spark, d), "clinic_id")


@query("WITH " + v.USERS + " SELECT id, concat('Law Group ', upper(firm_name)) AS entity_name, concat(', ', state) AS entity_address FROM (SELECT id, state, regexp_replace(firm_name, '^Law Group ', '') AS firm_name FROM users WHERE lawyer_id IS NULL)")
def q_placeholders(spark, d):
    return mutate.placeholder(v.users(spark, d).where("lawyer_id IS NULL"), "firm_name", "Firm ", "state").select("id", "entity_name", "entity_address")


# ---- exports and audits


@query("WITH " + v.TAGGED + """ SELECT concat('"', id, '","', replace(name, '"', '""'), '","', coalesce(array_to_string(specialties, '; '), ''), '","', CASE WHEN available THEN 'Yes' ELSE 'No' END, '"') AS line FROM tagged""")
def q_csv_export(spark, d):
    return exports.export_lines(v.tagged_clinics(spark, d), ["id", "name", "specialties", "available"])


@query("WITH " + v.USERS + " SELECT id, CAST(CASE WHEN role = 'lawyer' THEN lawyer_id END AS VARCHAR) AS lawyer_id, CAST(CASE WHEN role = 'clinic' THEN clinic_id END AS VARCHAR) AS clinic_id FROM users")
def q_role_link_consistency(spark, d):
    return audit.cleared_links(v.users(spark, d), "role", {"lawyer_id": "lawyer", "clinic_id": "clinic"}).select("id", F.col("lawyer_id").cast("string").alias("lawyer_id"), F.col("clinic_id").cast("string").alias("clinic_id"))


@query("SELECT 'status' AS \"check\", count(*) FILTER (o_orderstatus NOT IN ('P', 'O')) AS \"rows\" FROM orders UNION ALL SELECT 'price', count(*) FILTER (o_totalprice <= 1000) FROM orders")
def q_constraint_violations(spark, d):
    return audit.violations(v.table(spark, d, "orders", "o_orderstatus", "o_totalprice"), {"status": F.col("o_orderstatus").isin("P", "O"), "price": F.col("o_totalprice") > 1000})


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def q_duplicate_keys(spark, d):
    return audit.duplicates(v.table(spark, d, "orders", "o_custkey"), "o_custkey")


@query("WITH " + v.USERS + " SELECT id FROM users WHERE clinic_id = 12 AND id NOT IN (12, 312)")
def q_linked_by_others(spark, d):
    return audit.linked_by_others(v.users(spark, d), "clinic_id", 12, [12, 312]).select("id")


@query("WITH " + v.CLINICS + " SELECT id, name, county FROM clinics")
def q_private_columns(spark, d):
    return directory.without(v.clinics(spark, d), "address", "phone", "email", "lat", "lng", "region", "available")


@query("SELECT s_suppkey AS \"sSuppkey\", s_name AS \"sName\" FROM supplier")
def q_renamed(spark, d):
    return directory.renamed(v.table(spark, d, "supplier", "s_suppkey", "s_name"), directory.camel)
