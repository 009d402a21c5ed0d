"""Checks of contact data and forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted forms and domains.
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
USERNAME = r"^[a-zA-Z0-9_]{3,30}$"
PHONE = r"^[+\d\s().-]{7,20}$"
ROLES = ["lawyer", "clinic", "admin", "referrer", "partner"]
REFERRAL_STATUSES = ["received", "in_process", "attended"]
PARTNER_STATUSES = ["pending", "assigned", "in_process", "completed"]
CASE_STATES = ["pending", "confirmed"]
SERVICES = ["clinic", "lawyer", "both"]
STATES = ["FL", "MN"]
REFERRAL_KINDS = ["lawyer", "medical_specialist"]


def is_email(text: Column) -> Column:
    return F.coalesce(text.rlike(EMAIL), F.lit(False))


def is_username(text: Column) -> Column:
    return F.coalesce(text.rlike(USERNAME), F.lit(False))


def is_phone(text: Column) -> Column:
    return F.coalesce(text.rlike(PHONE), F.lit(False))


def has_phone_digits(text: Column) -> Column:
    """Seven to fifteen digits, whatever stands between them."""
    return F.coalesce(F.length(F.regexp_replace(text, "[^0-9]", "")).between(7, 15), F.lit(False))


def has_length(text: Column, least: int, most: int) -> Column:
    return F.coalesce(F.length(text).between(least, most), F.lit(False))


def is_one_of(text: Column, values: list[str]) -> Column:
    """Whether a value is one of a list; null is not."""
    return F.coalesce(text.isin(*values), F.lit(False))


def email_domain(text: Column) -> Column:
    """What stands behind the first @, in lower case; null if there is none."""
    return F.lower(F.get(F.split(text, "@"), F.lit(1)))


def first_error(checks: list[tuple[Column, str]]) -> Column:
    """The message of the first check that fails; null for a valid row."""
    found = F.lit(None).cast("string")
    for passes, message in reversed(checks):
        found = F.when(F.coalesce(passes, F.lit(False)), found).otherwise(F.lit(message))
    return found


def patch_of(body: Column, fields: dict[str, str]) -> Column:
    """The allowed fields of a JSON body; others and those of a wrong type are left out (null)."""
    return F.from_json(body, ", ".join(f"{k} {v}" for k, v in fields.items()))


def is_finite_number(text: Column) -> Column:
    number = text.try_cast("double")
    return F.coalesce(~F.isnan(number) & (F.abs(number) < float("inf")), F.lit(False))
