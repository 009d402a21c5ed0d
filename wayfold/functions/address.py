"""Addresses: building them, comparing them, and telling the state, city and street they name.

Word boundaries are those of ASCII, as in the rules these expressions follow.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold.functions.text import present, trimmed

# Street types and what they stand for.
STREET_TYPES = {
    "ste": "suite", "unit": "suite", "blvd": "boulevard", "dr": "drive", "st": "street", "ave": "avenue", "rd": "road",
    "hwy": "highway", "pkwy": "parkway", "ln": "lane", "ct": "court", "pl": "place", "cir": "circle", "ter": "terrace",
}
# Words before the number of a unit, which comparisons leave out.
UNIT_WORDS = ["suite", "ste", "unit", "building"]
# Compass letters and abbreviations in street names.
COMPASS = ["n", "s", "e", "w", "nw", "ne", "sw", "se"]
DOTTED = ["st", "ave", "blvd", "dr", "rd", "hwy", "pkwy"]
_BEGIN, _END = "(?<![a-zA-Z0-9_])", "(?![a-zA-Z0-9_])"


def _replaced(text: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda t, rule: F.regexp_replace(t, *rule), rules, text)


def in_state(address: Column, state: str) -> Column:
    """``, ST `` stands in the address, in any case."""
    return address.ilike(f"%, {state} %")


def state_of(address: Column, default: str = "", states: tuple[str, ...] = ("FL", "MN")) -> Column:
    """The first of the states whose ``, ST `` the address contains (in capitals)."""
    found = reduce(lambda c, s: c.when(address.contains(f", {s} "), s), states[1:], F.when(address.contains(f", {states[0]} "), states[0]))
    return found.otherwise(default)


def joined(parts: list[Column], state: str, zip_code: Column) -> Column:
    """The parts that are there, joined by commas; the state and the ZIP code are added where missing.

    A ZIP code is there if it stands as a number of its own: the digits of a longer number (of a house, of a name) are none.
    """
    street = F.concat_ws(", ", *[present(p) for p in parts])
    placed = F.when(street.contains(f", {state}"), street).otherwise(F.concat(street, F.lit(f", {state}")))
    alone = F.concat(F.lit(r"(?<![0-9])\Q"), zip_code, F.lit(r"\E(?![0-9])"))
    zipped = F.when(present(zip_code).isNull() | (placed.contains(zip_code) & F.regexp_like(placed, alone)), placed).otherwise(F.concat(placed, F.lit(" "), zip_code))
    return trimmed(_replaced(zipped, [(r",\s*,", ","), (r"\s+", " ")]))


def spelled_out(address: Column) -> Column:
    """Lower case with street types in full, dashes and suites in one form."""
    rules = [(r"\s+", " "), (r",\s*", ", "), *[(f"{_BEGIN}{k}{_END}", v) for k, v in STREET_TYPES.items()], (r"[–—\-]+", "-"), (r"suite\s*#?\s*", "suite "), (r"\s+", " ")]
    return F.coalesce(trimmed(_replaced(trimmed(F.lower(address)), rules)), F.lit(""))


def street_form(text: Column) -> Column:
    """Street names in one form: compass letters and abbreviations without dots, known long names short."""
    rules = [(f"{_BEGIN}martin luther king jr{_END}", "mlk jr"), (f"{_BEGIN}martin luther king{_END}", "mlk")]
    rules += [(f"{_BEGIN}{c}\\.?\\s*", f"{c} ") for c in COMPASS] + [(f"{_BEGIN}{a}\\.\\s", f"{a} ") for a in DOTTED] + [(r"\(hq\)\s*", ""), (r"\s+", " ")]
    return trimmed(_replaced(text, rules))


def core(address: Column, state: str = "fl") -> Column:
    """What stands before the state, without units and commas: equal for two spellings of one place."""
    before = F.get(F.split(trimmed(F.regexp_replace(F.lower(address), r"\s+", " ")), f",\\s*{state}{_END}"), F.lit(0))
    rules = [(f"{_BEGIN}{w}{_END}\\s*\\S*", "") for w in UNIT_WORDS] + [(r"(?<=[a-zA-Z0-9_])#\s*\S*", ""), (",", " "), (r"\s+", " ")]
    return F.coalesce(street_form(trimmed(_replaced(before, rules))), F.lit(""))


def city(address: Column, state: str = "fl") -> Column:
    """The part before the state, else the last part of what precedes it; empty if there is only one part."""
    lower = trimmed(F.lower(address))
    named = F.regexp_extract(lower, f",\\s*([^,]+?)\\s*,\\s*{state}{_END}", 1)
    chunks = F.split(F.get(F.split(lower, f",\\s*{state}{_END}"), F.lit(0)), ",")
    return F.coalesce(F.when(named != "", trimmed(named)).when(F.size(chunks) >= 2, trimmed(F.element_at(chunks, -1))), F.lit(""))


def house_digit(address: Column) -> Column:
    """The last digit of a leading number: the loose number by which listings are compared."""
    return F.regexp_extract(address, r"^\(?[a-zA-Z0-9_]*\)?\s*([0-9]+)", 1)


def first_street_word(street: Column) -> Column:
    return F.get(F.split(F.regexp_replace(street, r"^[0-9]+\s*", ""), r"\s+"), F.lit(0))


def is_vague(address: Column) -> Column:
    """No digit before the first comma."""
    return ~F.substring_index(address, ",", 1).rlike("[0-9]")
