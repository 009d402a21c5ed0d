"""Examples of the column functions."""

import pytest
from pyspark.sql import functions as F

from wayfold.functions import address, contact, dates, geo, text


def value(spark, column, **fields):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in fields.items()] or [F.lit(1).alias("_")])
    return row.select(column.alias("out")).first().out


@pytest.mark.parametrize(
    ("given", "expected"),
    [("<b>Hi</b>  ", "Hi"), (" plain ", "plain"), ("a<script>x</script>b", "axb"), ("", ""), ("1 < 2", "1 < 2"), (" nbsp ", "nbsp"), (None, None)],
)
def test_tags_are_stripped(spark, given, expected):
    assert value(spark, text.without_tags(F.col("t")), t=given) == expected


@pytest.mark.parametrize(
    ("given", "expected"),
    [("+1 (555) 010-0000", True), ("5550100", True), ("555-01", False), ("call me now", False), ("1" * 21, False), (None, False)],
)
def test_phones(spark, given, expected):
    assert value(spark, contact.is_phone(F.col("t").cast("string")), t=given) is expected


@pytest.mark.parametrize(("given", "expected"), [("a@b.co", True), ("a b@c.co", False), ("a@b", False), ("@b.co", False), ("a@@b.co", False)])
def test_emails(spark, given, expected):
    assert value(spark, contact.is_email(F.col("t")), t=given) is expected


@pytest.mark.parametrize(("given", "expected"), [("ab_3", True), ("ab", False), ("has space", False), ("x" * 31, False)])
def test_usernames(spark, given, expected):
    assert value(spark, contact.is_username(F.col("t")), t=given) is expected


@pytest.mark.parametrize(("number", "expected"), [(7, "c-007"), (123, "c-123"), (1234, "c-1234")])
def test_ids_are_padded_but_never_cut(spark, number, expected):
    assert value(spark, text.padded_id(F.col("n"), "c-"), n=number) == expected
    assert value(spark, text.suffix_number(F.lit(expected), "c-")) == number


def test_suffixes_of_other_ids_are_null(spark):
    assert value(spark, text.suffix_number(F.lit("ref-9"), "c-")) is None


def test_first_error_names_the_first_failed_check(spark):
    checks = [(F.lit(True), "a"), (F.lit(None).cast("boolean"), "b"), (F.lit(False), "c")]
    assert value(spark, contact.first_error(checks)) == "b"
    assert value(spark, contact.first_error(checks[:1])) is None


def test_distance_is_symmetric_and_zero_at_home(spark):
    there = geo.miles(F.lit(25.76), F.lit(-80.19), F.lit(44.98), F.lit(-93.27))
    back = geo.miles(F.lit(44.98), F.lit(-93.27), F.lit(25.76), F.lit(-80.19))
    assert value(spark, there) == value(spark, back) == pytest.approx(1511, abs=5)
    assert value(spark, geo.miles(F.lit(1.0), F.lit(2.0), F.lit(1.0), F.lit(2.0))) == 0


def test_points_on_an_axis_count_as_missing(spark):
    assert value(spark, geo.has_coordinates(F.lit(0.0), F.lit(5.0))) is False
    assert value(spark, geo.has_coordinates(F.lit(None).cast("double"), F.lit(5.0))) is False
    assert value(spark, geo.has_coordinates(F.lit(1.0), F.lit(5.0))) is True


@pytest.mark.parametrize(("then", "expected"), [("2024-01-31 11:59:30", "just now"), ("2024-01-31 11:15:00", "45m ago"), ("2024-01-31 01:00:00", "11h ago"), ("2024-01-29 12:00:00", "2d ago"), ("2024-01-02 12:00:00", "2024-01-02")])
def test_ages(spark, then, expected):
    assert value(spark, dates.age(F.lit(then).cast("timestamp"), F.lit("2024-01-31 12:00:00").cast("timestamp"))) == expected


def test_text_helpers(spark):
    assert value(spark, text.initials(F.lit("  ana maria lopez"))) == "AM"
    assert value(spark, text.truncated(F.lit("abcdef"), 3)) == "abc..."
    assert value(spark, text.short_number(F.lit(12_600))) == "13K"
    assert value(spark, text.html_escaped(F.lit('<a href="x">&'))) == "&lt;a href=&quot;x&quot;&gt;&amp;"
    assert value(spark, text.url_component(F.lit("a b/c"))) == "a%20b%2Fc"
    assert value(spark, text.listed(F.lit(" a, ,b "))) == ["a", "b"]
    assert value(spark, text.name_tokens(F.lit("The Smith & Jones Law-Firm, PA"))) == ["smith", "jones"]
    assert value(spark, text.first_and_more(F.array(*map(F.lit, "abcd")), 2)) == "a, b +2 more"
    assert value(spark, text.with_item(F.array(F.lit("a")), F.lit("a"))) == ["a"]
    assert value(spark, text.details_text(F.lit('{"b": 1, "a": "x", "ids": [1]}'))) == "a: x, b: 1"
    assert [tuple(r) for r in value(spark, text.labelled({"A": F.lit("x"), "B": F.lit(" "), "C": F.lit(None).cast("string")}))] == [("A", "x")]
    assert value(spark, text.or_else(F.lit(""), F.lit(None).cast("string"), "z")) == "z"


def test_addresses(spark):
    assert value(spark, address.joined([F.lit("1 A St"), F.lit("Town"), F.lit("")], "FL", F.lit("33101"))) == "1 A St, Town, FL 33101"
    assert value(spark, address.spelled_out(F.lit("12  Oak St., Ste #4"))) == "12 oak street., suite 4"
    one = value(spark, address.core(F.lit("100 N. Ocean Ave, Suite 5, Miami, FL 33101")))
    two = value(spark, address.core(F.lit("100 N Ocean Ave, Miami, FL")))
    assert one == two
    assert value(spark, address.city(F.lit("100 Ocean Ave, Miami Beach, FL 33101"))) == "miami beach"
    assert value(spark, address.house_digit(F.lit("1234 Oak"))) == "4"
    assert value(spark, address.is_vague(F.lit("Main Street, Town 5"))) is True
    assert value(spark, address.state_of(F.lit("x, Town, MN 55"))) == "MN"


def test_digits_of_longer_numbers_are_no_zip_code(spark):
    def joined(place: str, code: str) -> str:
        return value(spark, address.joined([F.lit(place), F.lit("Town")], "MN", F.lit(code)))

    assert joined("Supplier#000055042", "55042") == "Supplier#000055042, Town, MN 55042"
    assert joined("550421 Oak", "55042") == "550421 Oak, Town, MN 55042"
    assert joined("55042", "55042") == "55042, Town, MN"
    assert joined("1 Oak, MN 55042-1", "55042") == "1 Oak, MN 55042-1, Town"
    assert joined("1 Oak", "55.42") == "1 Oak, Town, MN 55.42"
