"""Text functions: e-mail domains, hosts, licence names, comma lists, column names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that define the results.
LICENSE_PATTERN = r"(\S+)\s*License"
DIGITS_PATTERN = "^[0-9]+$"


def email_domain(email: Column) -> Column:
    """Text after the first ``@``, empty when there is none, null for null."""
    return F.when(
        F.instr(email, "@") > 0, F.substring(email, F.instr(email, "@") + 1, F.length(email))
    ).when(email.isNotNull(), F.lit(""))


def url_host(url: Column) -> Column:
    """Text between the first ``//`` and the next ``/`` without any ``www.``; port and query stay."""
    rest = F.when(
        F.instr(url, "//") > 0, F.substring(url, F.instr(url, "//") + 2, F.length(url))
    ).when(url.isNotNull(), F.lit(""))
    return F.replace(F.split_part(rest, F.lit("/"), F.lit(1)), F.lit("www."), F.lit(""))


def license_names(products: Column) -> Column:
    """Distinct words before ``License`` in a product text; empty for null."""
    found = F.regexp_extract_all(products, F.lit(LICENSE_PATTERN), F.lit(1))
    return F.coalesce(F.array_distinct(found), F.array().cast("array<string>"))


def is_digits(text: Column) -> Column:
    """True for text made of digits only; false for null."""
    return F.coalesce(text.rlike(DIGITS_PATTERN), F.lit(False))


def _unquoted(item: Column) -> Column:
    return F.regexp_replace(item, '^"+|"+$', "")


def comma_list(text: Column) -> Column:
    """Items of a comma list, outer double quotes taken off each, blanks kept; empty for null."""
    items = F.transform(F.split(text, ","), _unquoted)
    return F.coalesce(items, F.array().cast("array<string>"))


def comma_list_strict(text: Column) -> Column:
    """Like ``comma_list``, but only a text without a comma loses its quotes."""
    items = F.when(F.contains(text, F.lit(",")), F.split(text, ",")).otherwise(
        F.array(_unquoted(text))
    )
    return F.when(text.isNotNull(), items).otherwise(F.array().cast("array<string>"))


def normalized_name(name: str, prefix: str = "") -> str:
    """Column name with prefix, trimmed, in lower case, blanks turned into underscores."""
    return (prefix + name).strip().lower().replace(" ", "_")
