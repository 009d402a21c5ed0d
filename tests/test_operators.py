"""Small frames for matching, changes of state, listings and audits."""

import random
import re

import pytest
from pyspark.sql import functions as F

from wayfold.operators import audit, containment, directory, mutate, referrals, resolve
from wayfold.sources import exports, listings, tables
from wayfold.streaming import activity


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_upsert_is_idempotent_and_last_wins(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "x"), (3, "y")], "id int, v string")
    once = mutate.upserted(base, new, "id")
    assert rows(once) == [(1, "a"), (2, "x"), (3, "y")] == rows(mutate.upserted(once, new, "id"))


def test_patch_touches_only_hit_rows(spark):
    base = spark.createDataFrame([(1, "a", None), (2, None, None)], "id int, v string, at string")
    out = mutate.patched(base, spark.createDataFrame([(2, "n")], "id int, v string"), "id", ["v"], "at", "2024")
    assert rows(out) == [(1, "a", None), (2, "n", "2024")]


def test_delete_keeps_unknown_rows_and_the_protected(spark):
    base = spark.createDataFrame([(1,), (2,), (None,)], "id int")
    assert rows(mutate.deleted(base, F.col("id") == 1)) == [(2,), (None,)]
    kept, gone = mutate.deleted_ids(base, "id", base, never=2)
    assert rows(kept) == [(2,), (None,)] and gone.first().deleted == 1


def test_backfill_takes_the_least_match_and_keeps_what_is_there(spark):
    people = spark.createDataFrame([(1, "A@x", None), (2, "b@x", 9)], "id int, email string, firm int")
    firms = spark.createDataFrame([(5, "a@X"), (4, "a@x"), (7, "B@X")], "id int, email string")
    assert rows(mutate.backfilled(people, firms, "firm", "email", "id"), "id", "firm") == [(1, 4), (2, 9)]


def test_numbering_has_no_gaps(spark):
    out = mutate.numbered(spark.range(1000).withColumn("x", -F.col("id")), [F.col("x")])
    assert rows(out, "nth", "id") == sorted(((1000 - i, i) for i in range(1000)), key=repr)


def test_a_million_rows_keep_their_columns_and_get_each_number_once(spark):
    df = spark.range(1_000_000).select("id", F.pmod(F.xxhash64("id"), F.lit(5000)).alias("x"), F.concat(F.lit("kept "), "id").alias("more"))
    out = mutate.numbered(df, [F.col("x"), F.col("id")])
    assert out.agg(F.count("*"), F.countDistinct("nth"), F.min("nth"), F.max("nth")).first() == (1_000_000, 1_000_000, 1, 1_000_000)
    assert out.where(F.col("more") != F.concat(F.lit("kept "), "id")).isEmpty()
    before = out.select((F.col("nth") + 1).alias("nth"), F.struct("x", "id").alias("last"))
    assert out.join(before, "nth").where(F.struct("x", "id") <= F.col("last")).isEmpty()


def test_deep_pages_are_those_of_a_sorted_list(spark):
    df = spark.range(30_000).select("id", (-F.col("id")).alias("x"), F.lit("kept").alias("more"))
    found = referrals.page(df, [F.col("x")], 500, 50).orderBy("nth").collect()
    assert [(r.nth, r.id, r.more, r.total, r.pages) for r in found] == [(24_951 + i, 29_999 - 24_950 - i, "kept", 30_000, 600) for i in range(50)]


def test_upsert_takes_null_keys_as_unlike_and_ties_by_value(spark):
    base = spark.createDataFrame([(None, "n"), (1, "a")], "id int, v string")
    new = spark.createDataFrame([(None, "m"), (None, "m"), (1, "x"), (1, "y"), (1, None)], "id int, v string")
    assert rows(mutate.upserted(base, new, "id")) == sorted([(None, "n"), (None, "m"), (None, "m"), (1, "y")], key=repr)


def test_texts_inside_texts_equal_all_pairs(spark):
    shorts = [(i, s, i % 2) for i, s in enumerate(["a", "ab", "abc", "abcd", "bcd", "zz", "", "abab", "cdab", None, "abc"])]
    longs = [(i, s, i % 2) for i, s in enumerate(["abcd", "xxab", "", "abab", "zabcdz", "b", None, "cdabab"])]
    left, right = spark.createDataFrame(shorts, "i int, s string, g int"), spark.createDataFrame(longs, "j int, l string, g int")
    expected = sorted((i, j) for i, s, g in shorts for j, t, h in longs if s and t and g == h and s in t)
    assert sorted(tuple(r) for r in resolve.contained(left, right, "s", "l", ["g"]).select("i", "j").collect()) == expected


def test_lookups_name_the_first_reference_that_leads_nowhere(spark):
    new = spark.createDataFrame([(1, 7, "u"), (2, 8, "u"), (3, None, "w"), (4, 9, "w")], "id int, c int, u string")
    clinics = spark.createDataFrame([(7, "A"), (7, "B"), (9, None)], "k int, name string")
    users = spark.createDataFrame([("u", "Ann")], "k string, name string")
    out = referrals.with_lookups(new, {"c": (clinics, "k", {"name": "clinic"}, "no clinic"), "u": (users, "k", {"name": "user"}, "no user")})
    assert rows(out, "id", "clinic", "user", "error") == [(1, "A", "Ann", None), (2, None, "Ann", "no clinic"), (3, None, None, "no user"), (4, None, None, "no user")]


def test_links_are_rewritten_once(spark):
    df = spark.createDataFrame([(1, "u1", "u1"), (2, "u1", "f9"), (3, "u2", "u2"), (4, None, None)], "id int, creator string, firm string")
    source = spark.createDataFrame([("u1", "f1"), ("u1", "f0"), ("u3", "f3")], "creator string, own string")
    run = lambda d: mutate.rewritten(d, source, "creator", "firm", F.col("own"), F.col("firm") == F.col("creator"))
    assert rows(run(df), "id", "firm") == [(1, "f0"), (2, "f9"), (3, "u2"), (4, None)] == rows(run(run(df)), "id", "firm")


def test_first_wins_and_merge(spark):
    data = spark.createDataFrame([(3, "k", "b"), (1, "k", "a"), (2, "j", "a"), (4, "k", "a")], "ord int, key string, tag string")
    assert rows(resolve.first_wins(data, [F.col("key")], [F.col("ord")]), "ord", "key") == [(1, "k"), (2, "j")]
    assert rows(resolve.merged_tags(data, ["key"], "tag", "ord", ["ord"]), "key", "tags", "ord") == [("j", ["a"], 2), ("k", ["a", "b"], 1)]


def test_orphans_with_and_without_nulls(spark):
    children = spark.createDataFrame([(1, 1), (2, 9), (3, None)], "id int, parent int")
    parents = spark.createDataFrame([(1,)], "pid int")
    assert rows(resolve.orphans(children, "parent", parents, "pid"), "id") == [(2,), (3,)]
    assert rows(resolve.orphans(children, "parent", parents, "pid", strict=True), "id") == [(2,)]


def test_addresses_match_the_first_existing(spark):
    old = spark.createDataFrame([(10, "100 Ocean Ave, Miami, FL 1", 0), (11, "100 Ocean Ave, Miami, FL 2", 1), (12, "5 Elm St, Tampa, FL", 2)], "id int, address string, place int")
    new = spark.createDataFrame([(1, "100 Ocean Ave, Suite 3, Miami, FL"), (2, "15 Elm Road, Tampa, FL"), (3, "Pine, Ocala, FL"), (4, None)], "id int, address string")
    assert rows(resolve.by_address(new, old), "id", "match_id") == [(1, 10), (2, 12), (3, None), (4, None)]


def test_unique_match_only(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "b", "x")], "id int, name string, phone string")
    patch = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "name string, new string")
    assert rows(resolve.matched_once(base, patch, "name", {"phone": "new"}), "id", "phone") == [(1, "1"), (2, "x"), (3, "x")]


def test_labels_keep_rule_order_and_default(spark):
    data = spark.createDataFrame([("Sports injury rehab",), ("nothing",), (None,)], "t string")
    out = [r.x for r in data.select(resolve.labelled(F.col("t"), resolve.SERVICE_RULES, "General Medicine").alias("x")).collect()]
    assert out == [["Sports Medicine", "Rehabilitation", "Injury Clinic"], ["General Medicine"], ["General Medicine"]]
    note = resolve.labelled(F.lit("whiplash"), resolve.NOTE_RULES, "General Medicine", resolve.TYPE_LABELS, F.lit(" Terapia Física "))
    assert spark.range(1).select(note.alias("x")).first().x == ["Physical Therapy", "Whiplash Treatment"]


def test_regions(spark):
    data = spark.createDataFrame([("Hennepin",), ("Nowhere",)], "county string")
    assert rows(resolve.with_region(data, "county"), "county", "region") == [("Hennepin", "Twin Cities Metro"), ("Nowhere", "Minnesota")]


def test_csv_listings(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿Name ,Address,County,ZIP\n"Firm A","1 A St, Town",Dade,1\n🏥 Part,,,\nFirm B,2 B St,,\nshort,row\nFirm C,3 C St,Lake,4,extra\n', encoding="utf-8")
    files = {"auto": str(tmp_path / "a.csv"), "none": str(tmp_path / "missing.csv")}
    read = listings.read_csv_files(spark, files, ["Name", "Address", "County", "ZIP"], "area")
    (tmp_path / "b.csv").write_text('a,b,c\n4,5,,extra\n"x\ny",2,3\n\n1,2\n')
    assert rows(listings.read_csv(spark, str(tmp_path / "b.csv"), ["a", "b", "c"])) == [("4", "5", ""), ("x\ny", "2", "3")]
    good = read.where(~listings.is_section_row(F.col("Name"), F.col("Address"), F.col("County")))
    assert rows(good, "Name", "Address", "area") == [("Firm A", "1 A St, Town", "auto"), ("Firm B", "2 B St", "auto"), ("Firm C", "3 C St", "auto")]


def test_firms_of_several_files_merge(spark):
    data = spark.createDataFrame([("A. Firm", "1 A St", "33", "p1", "c", "r", "auto", 0, 0), ("a firm", "1 a st", "33", "p2", "c", "r", "work", 1, 0)], "name string, address string, zip string, phone string, county string, region string, area string, file int, line long")
    out = listings.merged_firms(data, "FL").first()
    assert (out["name"], out["phone"], out.areas) == ("A. Firm", "p1", ["auto", "work"])


def test_markdown_lists(spark, tmp_path):
    text = "# South\n## Dade\n1. **One Clinic**\n📍 1 A St, Town\n📞 555\n2. Two\n🌐 x.example\n## Lake\n3. Three\n📍 3 C St\n📍 4 D St\n"
    (tmp_path / "l.md").write_text(text, encoding="utf-8")
    out = listings.read_markdown(spark, str(tmp_path / "l.md"))
    (tmp_path / "two").mkdir()
    for n in ("a", "b"):
        (tmp_path / "two" / f"{n}.md").write_text(text if n == "a" else "1. Alone\n📍 9 Z St\n", encoding="utf-8")
    assert ("Alone", None, None) in rows(listings.read_markdown(spark, str(tmp_path / "two")), "name", "region", "county")
    assert rows(out, "record", "addresses", "phone", "region", "county") == [(1, ["1 A St, Town"], "555", "South", "Dade"), (3, ["3 C St", "4 D St"], None, "South", "Lake")]


def test_json_records(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"schema": 1, "records": [{"name": "a"}, {"name": null}]}')
    (tmp_path / "e.json").write_text('[{"name": "a"}]')
    assert rows(listings.read_json_records(spark, str(tmp_path / "d.json"), "name: string")) == [("a",), (None,)]
    assert rows(listings.read_json_records(spark, str(tmp_path / "e.json"), "name string", None)) == [("a",)]


def test_coordinates_fall_back_to_the_town(spark):
    cache = spark.createDataFrame([("1 A St, Town", 1.0, 2.0), ("Town", 3.0, 4.0), ("9 Z, Gone", None, None)], "place string, lat double, lng double")
    data = spark.createDataFrame([("1 A St, Town",), ("7 B St, Town",), ("9 Z, Gone",)], "address string")
    assert rows(listings.located(data, cache), "address", "lat") == [("1 A St, Town", 1.0), ("7 B St, Town", 3.0), ("9 Z, Gone", 0.0)]


def test_export_quotes_everything(spark, tmp_path):
    data = spark.createDataFrame([(1, 'say "hi"', ["a", "b"], True), (2, None, None, False)], "id int, t string, tags array<string>, ok boolean")
    assert [r.line for r in exports.export_lines(data, data.columns).orderBy("line").collect()] == ['"1","say ""hi""","a; b","Yes"', '"2","","","No"']
    exports.write_csv(data, data.columns, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True, escape='"').where("id = 1").first().t == 'say "hi"'


def test_visibility_and_editing(spark):
    data = spark.createDataFrame([(1, 7, 1, 2), (2, 8, 3, 1)], "id int, lawyer_id int, clinic_id int, target_clinic_id int")
    assert rows(referrals.visible_to(data, "admin"), "id") == [(1,), (2,)]
    assert rows(referrals.visible_to(data, "lawyer", firm_id=7), "id") == [(1,)]
    assert rows(referrals.visible_to(data, "clinic", clinic_id=1), "id") == [(1,), (2,)]
    assert rows(referrals.visible_to(data, "referrer"), "id") == []


def test_pages_cover_all_rows_once(spark):
    data = spark.range(11)
    seen = [r.id for n in (1, 2, 3) for r in referrals.page(data, [F.col("id")], n, 4).orderBy("id").collect()]
    assert seen == list(range(11))
    assert referrals.page(data, [F.col("id")], 1, 0).first().pages == 11


def test_status_counts_of_nothing(spark):
    empty = spark.createDataFrame([], "s string")
    assert tuple(referrals.status_counts(empty, "s", {"F": "done"}, "done").first()) == (0, 0, 0)


def test_lookup_of_a_repeated_key_finds_nothing(spark):
    data = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    assert rows(directory.only(data, "id", 1)) == [] and rows(directory.only(data, "id", 2)) == [(2,)]


def test_documents_project_arrays(spark):
    data = spark.createDataFrame([("faq", "T", [("q", "a")])], "_type string, title string, items array<struct<q:string,a:string>>")
    out = directory.document(data, "faq", ["title", "items"], {"items": ["q"]}).first()
    assert out.title == "T" and out["items"][0].asDict() == {"q": "q"}


def test_names_change_style_and_back(spark):
    data = spark.createDataFrame([(1, 2)], "first_name int, x int")
    assert directory.renamed(data, directory.camel).columns == ["firstName", "x"]
    assert directory.renamed(directory.renamed(data, directory.camel), directory.snake).columns == data.columns


def test_audits(spark):
    users = spark.createDataFrame([(1, "lawyer", 5)], "id int, role string, lawyer_id int")
    gaps = audit.schema_gaps(spark, {"contacts": users}, {"contacts": tables.schema("contacts")})
    assert gaps.count() == 6  # all but id
    assert rows(audit.violations(users, {"role": F.col("role").isin("admin"), "id": F.col("id") > 0})) == [("id", 0), ("role", 1)]
    assert rows(audit.health({"users": users, "none": users.where("id > 5")})) == [("none", False), ("users", True)]


def test_streams_count_like_tables(spark, tmp_path):
    data = spark.createDataFrame([("2024-01-01 01:00:00", "a"), ("2024-01-01 02:00:00", "a"), ("2024-01-05 00:00:00", "b")], "ts string, kind string").withColumn("ts", F.col("ts").cast("timestamp"))
    data.write.parquet(str(tmp_path / "in"))
    batch = rows(activity.windowed(data, "ts", "kind"))
    stream = activity.windowed(spark.readStream.schema(data.schema).parquet(str(tmp_path / "in")), "ts", "kind")
    started = stream.writeStream.outputMode("complete").format("memory").queryName("seen").start()
    try:
        started.processAllAvailable()
        assert rows(spark.sql("SELECT * FROM seen")) == batch
    finally:
        started.stop()


def test_texts_inside_texts_over_many_ranges(spark):
    """Nested texts of few letters, so that sorted ranges begin in the middle of chains of texts inside texts."""
    draw = random.Random(5)
    texts = lambda n, most: ["".join(draw.choice("ab ") for _ in range(draw.randint(0, most))) for _ in range(n)]
    shorts, longs = list(enumerate(texts(80, 5))), list(enumerate(texts(60, 12)))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        left, right = spark.createDataFrame(shorts, "i int, s string"), spark.createDataFrame(longs, "j int, l string")
        found = rows(containment.contained(left, right, "s", "l"), "i", "j")
        held = right.select(F.lit("t").alias("town"), F.col("l").alias("x"), F.struct(F.col("j").alias("place"), F.lit(None).cast("string").alias("n")).alias("v"))
        least = rows(containment.least_related(left.select(F.lit("t").alias("town"), F.col("s").alias("x")), held, "town", "x", "v").select("x", F.col("v.place").alias("p")), "x", "p")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == sorted(((i, j) for i, s in shorts for j, t in longs if s and s in t), key=repr)
    hits = {s: [j for j, t in longs if t and (s in t or t in s)] for _, s in shorts if s}
    assert least == sorted(((s, min(h)) for s, h in hits.items() if h), key=repr)


def _same_place(a: str, b: str) -> bool:
    """The four rules for two addresses, one after the other."""

    def core(x: str) -> str:
        x = re.split(r",\s*fl\b", re.sub(r"\s+", " ", x.lower().strip()), flags=re.A)[0]
        for pattern, into in [
            (r"\bsuite\b\s*\S*", ""), (r"\bste\b\s*\S*", ""), (r"\bunit\b\s*\S*", ""), (r"\bbuilding\b\s*\S*", ""), (r"\b#\s*\S*", ""), (",", " "), (r"\s+", " "), (r"^ | $", ""), (r"\bmartin luther king jr\b", "mlk jr"), (r"\bmartin luther king\b", "mlk"),
            *[(rf"\b{c}\.?\s*", f"{c} ") for c in "n s e w nw ne sw se".split()], *[(rf"\b{c}\.\s", f"{c} ") for c in "st ave blvd dr rd hwy pkwy".split()], (r"\(hq\)\s*", ""), (r"\s+", " "),
        ]:
            x = re.sub(pattern, into, x, flags=re.A)
        return x.strip()

    def city(x: str) -> str:
        x = x.lower().strip()
        named = re.search(r",\s*([^,]+?)\s*,\s*fl\b", x, flags=re.A)
        chunks = re.split(r",\s*fl\b", x, flags=re.A)[0].split(",")
        return named[1].strip() if named else chunks[-1].strip() if len(chunks) > 1 else ""

    def number(x: str) -> str:
        told = re.match(r"^\(?\w*\)?\s*([0-9]+)", x, flags=re.A)
        return told[1] if told else ""

    if core(a) == core(b):
        return True
    if not city(a) or city(a) != city(b):
        return False
    if core(a) and core(b) and (core(a) in core(b) or core(b) in core(a)):
        return True
    word = lambda x: re.split(r"\s+", re.sub(r"^[0-9]+\s*", "", core(x)))[0]
    return bool(number(a)) and number(a) == number(b) and bool(word(a)) and word(a) == word(b)


def test_addresses_match_by_all_four_rules(spark):
    draw = random.Random(9)
    kinds = ["{n} N. Oak St., Suite {m}, {c}, FL", "{n} n oak st, {c}, FL 3", "{n} Martin Luther King Jr Blvd, {c}, FL", "{n} MLK Jr Blvd. Unit {m}, {c} , FL", "(HQ) {n} Pine Hwy., {c}, FL", "1{n} Pine Hwy., {c}, FL", "Pine Hwy, {c}, FL", "{n} Oak, {c}", "{n}0 Elm Rd #4 {c}, FL", "", "{c}, FL"]
    made = lambda: draw.choice(kinds).format(n=draw.randint(1, 12), m=draw.randint(1, 3), c=draw.choice(["Miami", "Key West", "Ne"]))
    new, old = [(i, made()) for i in range(150)], [(100 + i, made(), draw.randint(0, 40)) for i in range(120)]
    out = resolve.by_address(spark.createDataFrame(new, "id int, address string"), spark.createDataFrame(old, "id int, address string, place int"))
    expected = [(i, min(((p, j) for j, b, p in old if _same_place(a, b)), default=(None, None))[1]) for i, a in new]
    assert rows(out, "id", "match_id") == sorted(expected, key=repr)
    assert len({j for _, j in expected}) > 20


@pytest.mark.parametrize("bound", [100_000, 0])
def test_token_matches_of_equal_names_do_not_grow_with_their_rows(spark, monkeypatch, bound):
    """Only the first rows of equal names are searched, repeated ids and names give every pair once, and so does the join beyond the broadcast."""
    monkeypatch.setattr(resolve, "BROADCAST_ROWS", bound, raising=False)
    searched, real = [], resolve.contained
    monkeypatch.setattr(resolve, "contained", lambda shorts, longs, *more: searched.append(longs.count()) or real(shorts, longs, *more))
    left = [(1, "Law Oak Group"), (1, "Oak Pine"), (2, "Oak Pine"), (2, "Oak Pine"), (3, None), (4, "of"), (None, "pine")]
    right = [(i, ["Big OAK", "Pine oak", "Elm", None][i % 4]) for i in range(400)] + [(None, "Pinecone")]
    got = resolve.by_token(spark.createDataFrame(left, "id int, firm string"), spark.createDataFrame(right, "id int, name string"), "firm", "name", 3)
    expected = set()
    for i, firm in left:
        for token in (firm or "").lower().split():
            if len(token) > 2 and token not in ("law", "group"):
                hits = sorted((n, m is not None, m or 0) for m, n in right if n and token in n.lower())[:3]
                expected |= {(i, m if known else None, n) for n, known, m in hits}
    found = [tuple(r) for r in got.select("id", "match_id", "match_name").collect()]
    assert len(found) == len(set(found)) and set(found) == expected
    assert searched and max(searched) <= 3 * 5
