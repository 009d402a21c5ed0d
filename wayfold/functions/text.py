"""Text expressions. Null in, null out, unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that name no particular firm.
STOP_WORDS = ["law", "firm", "group", "and", "the", "associates", "legal"]


def trimmed(text: Column) -> Column:
    """Without white space of any alphabet at either end (``F.trim`` takes spaces only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapsed(text: Column) -> Column:
    """Trimmed, every run of white space one space."""
    return trimmed(F.regexp_replace(text, r"(?U)\s+", " "))


def present(text: Column) -> Column:
    """Null for an empty text: what counts as missing in forms and listings."""
    return F.nullif(text, F.lit(""))


def or_else(text: Column, *others: Column | str) -> Column:
    """The first that is neither null nor empty."""
    columns = [text, *[o if isinstance(o, Column) else F.lit(o) for o in others]]
    return F.coalesce(*[present(c) for c in columns[:-1]], columns[-1])


def without_tags(text: Column) -> Column:
    """Markup tags removed, then trimmed."""
    return trimmed(F.regexp_replace(text, "<[^>]*>", ""))


def html_escaped(text: Column) -> Column:
    """The four characters that would be read as markup, as entities."""
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")], text)


def url_component(text: Column) -> Column:
    """Percent-encoded, spaces as %20."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def matching_form(text: Column) -> Column:
    """Lower case, single spaces, no punctuation: for comparing names."""
    return collapsed(F.regexp_replace(F.lower(text), r"[.,;:'\"()\-]", ""))


def name_tokens(name: Column, stop_words: list[str] | None = None) -> Column:
    """The telling words of a name: lower-case ASCII words of three letters and more that are no stop words."""
    words = F.split(F.regexp_replace(F.lower(name), r"[^a-z0-9\s]", " "), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS if stop_words is None else stop_words))


def initials(name: Column, most: int = 2) -> Column:
    """The first letters of the first words."""
    words = F.filter(F.split(trimmed(name), r"\s+"), lambda w: w != "")
    return F.upper(F.array_join(F.transform(F.slice(words, 1, most), lambda w: F.left(w, F.lit(1))), ""))


def truncated(text: Column, most: int, mark: str = "...") -> Column:
    """Longer texts cut to ``most`` characters and marked."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def padded_id(number: Column, prefix: str, width: int = 3) -> Column:
    """``prefix`` and the number with leading zeros; longer numbers stay whole."""
    text = number.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text))


def suffix_number(identifier: Column, prefix: str) -> Column:
    """The number behind a prefix, null for other identifiers."""
    return F.try_to_number(F.nullif(F.regexp_extract(identifier, f"^{prefix}([0-9]+)$", 1), F.lit("")), F.lit("9" * 12)).cast("long")


def short_number(number: Column, mark: str = "K") -> Column:
    """From a thousand on as rounded thousands."""
    return F.when(number >= 1000, F.concat(F.floor(number / 1000 + 0.5).cast("string"), F.lit(mark))).otherwise(number.cast("string"))


def listed(text: Column) -> Column:
    """A comma-separated text as an array of its trimmed parts, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), trimmed), lambda x: x != "")


def cleaned(items: Column) -> Column:
    """An array's texts without markup, without nulls and empty ones."""
    return F.filter(F.transform(items, without_tags), lambda x: x.isNotNull() & (x != ""))


def first_and_more(items: Column, most: int) -> Column:
    """The first items joined, and how many follow."""
    rest = F.greatest(F.size(items) - most, F.lit(0))
    return F.concat(F.array_join(F.slice(items, 1, most), ", "), F.when(rest > 0, F.concat(F.lit(" +"), rest.cast("string"), F.lit(" more"))).otherwise(""))


def with_item(items: Column, item: Column) -> Column:
    """The array with the item at its end, unless it is there or empty."""
    return F.when((item == "") | F.array_contains(items, item), items).otherwise(F.concat(items, F.array(item)))


def first_parts(text: Column, most: int) -> Column:
    """The first comma-separated parts."""
    return F.substring_index(text, ",", most)


def labelled(pairs: dict[str, Column]) -> Column:
    """(label, value) of those values that are not blank, in order."""
    rows = F.array(*[F.struct(F.lit(k).alias("label"), v.alias("value")) for k, v in pairs.items()])
    return F.filter(rows, lambda r: r.value.isNotNull() & (trimmed(r.value) != ""))


def parsed_float(text: Column) -> Column:
    """The number that a text begins with, whatever follows it; null if it begins with none."""
    return F.nullif(F.regexp_extract(text, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1), F.lit("")).try_cast("double")


def parsed_int(text: Column) -> Column:
    """The whole number that a text begins with."""
    return F.nullif(F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1), F.lit("")).try_cast("long")


def one_decimal(number: Column, places: int = 1) -> Column:
    """A number rounded to fixed decimals, halves away from zero."""
    return F.round(number.cast("double"), places)


def derived_key(prefix: str, *parts: Column, length: int = 8) -> Column:
    """A prefix and the first hexadecimal digits of a digest of the parts: the same row always gets the same key."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]), 256), 1, length))


def lookup(value: Column, labels: dict[str, str]) -> Column:
    """The label of a value, the value itself if it has none."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])[value], value)


def details_text(details: Column, hidden: tuple[str, ...] = ("ids",)) -> Column:
    """A JSON object as ``key: value`` pairs, sorted by key, without the hidden keys."""
    shown = F.map_filter(F.from_json(details, "map<string,string>"), lambda k, v: ~k.isin(*hidden))
    return F.array_join(F.transform(F.array_sort(F.map_entries(shown)), lambda e: F.concat(e.key, F.lit(": "), F.coalesce(e.value, F.lit("")))), ", ")


def starts_with_pictograph(text: Column) -> Column:
    """Whether a line opens with a pictograph, as section rows of hand-made lists do."""
    return text.rlike(r"^[\x{1F000}-\x{1FFFF}]")
