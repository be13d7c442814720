"""Cleaning of the single sources: revenue, messaging, e-mail, CRM, survey, support contacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custvalue.functions.lists import distinct_items, first_item, item_field, nested_field
from custvalue.functions.nulls import named
from custvalue.functions.text import comma_list, comma_list_strict, email_domain, url_host
from custvalue.operators.aggregates import first_known_per_key, indicators, item_values, one_hot
from custvalue.operators.columns import normalized
from custvalue.operators.joins import outer_join, with_group_values

# The column prefix of each source.
REVENUE, MESSAGING, EMAILS = "revenue:", "intercom:", "drip:"
CRM_CONTACTS, CRM_COMPANIES = "hubcust:", "hubcomp:"
SURVEY, SUPPORT = "turk:", "helpscout:"

# Support contact types that become columns, and the names of those columns.
PHONE_TYPES = {"home": "home_phone", "mobile": "mobile_phone", "work": "work_phone"}
EMAIL_TYPES = {"other": "other_type_email", "work": "work_email"}


def clean_revenue(revenue: DataFrame) -> DataFrame:
    """Normalised names and the domain of each e-mail."""
    clean = normalized(revenue, REVENUE)
    return clean.withColumn("revenue:domain", email_domain(named("revenue:email")))


def clean_contacts(contacts: DataFrame, segments: Sequence[str] | None = None) -> DataFrame:
    """One row per e-mail, earliest known values, with a column per segment.

    Rows seen first at the same time go by a hash of the row, so that reruns agree.
    """
    tied = contacts.withColumn("__tie", F.xxhash64(*map(named, contacts.columns)))
    reduced = first_known_per_key(tied, "Email", ["First Seen (MDT)", "__tie"]).drop("__tie")
    first = normalized(reduced, MESSAGING)
    listed = first.withColumn("intercom:segment", comma_list(named("intercom:segment")))
    segments = item_values(listed, "intercom:segment") if segments is None else segments
    return indicators(listed, "intercom:segment", segments)


def clean_subscribers(
    subscribers: DataFrame, campaigns: Sequence[str] | None = None, strict: bool = False
) -> DataFrame:
    """Subscribers with a column per campaign. ``strict`` leaves the quotes on items of a
    list and takes them off a single item only."""
    clean = normalized(subscribers, EMAILS)
    items = (comma_list_strict if strict else comma_list)(named("drip:campaign_names"))
    listed = clean.withColumn("drip:campaign_names", items)
    campaigns = item_values(listed, "drip:campaign_names") if campaigns is None else campaigns
    return indicators(listed, "drip:campaign_names", campaigns)


def clean_crm_contacts(contacts: DataFrame) -> DataFrame:
    return normalized(contacts, CRM_CONTACTS)


def clean_crm_companies(companies: DataFrame) -> DataFrame:
    return normalized(companies, CRM_COMPANIES)


def clean_survey(answers: DataFrame, industries: Sequence[str] | None = None) -> DataFrame:
    """Answers on sites that opened: host, mean rating of the address, industry columns."""
    # The answer that says yes, and the columns of the export.
    yes, url, rating, industry = "yes", "Input.website_url", "Answer.well-made", "Answer.industry"
    opened = answers.where(
        (named("Answer.can_access") == yes) & (named("Answer.does_it_load") == yes)
    ).select(named(url), named(industry), named(rating))
    hosts = opened.withColumn("turk_domain", url_host(named(url)))
    rated = with_group_values(hosts, url, {f"{rating}_y": F.avg(named(rating))}).drop(rating)
    flagged = one_hot(rated, industry, industries, drop_first=True, null_column=True)
    return normalized(flagged, SURVEY)


def support_contacts(pages: DataFrame, details: DataFrame) -> DataFrame:
    """Contacts of the list answers with the detail answers' nested parts taken out.

    ``pages`` are items of the paged list, one row per contact; ``details`` hold one ``item``
    record each.
    """
    item = F.col("item")
    detail = details.select(
        item["id"].alias("id"),
        item_field(item["emails"], "location").alias("email_types"),
        item_field(item["emails"], "value").alias("emails"),
        item_field(item["socialProfiles"], "value").alias("socialProfiles_links"),
        item_field(item["socialProfiles"], "type").alias("socialProfiles"),
        item_field(item["websites"], "value").alias("websites"),
        *[
            nested_field(item, ("address", part)).alias(part)
            for part in ("city", "country", "postalCode", "state")
        ],
        item_field(item["chats"], "type").alias("chats"),
        item_field(item["phones"], "location").alias("phone_types"),
        item_field(item["phones"], "value").alias("phones"),
    )
    return outer_join(pages, detail, "id")


def clean_support(contacts: DataFrame) -> DataFrame:
    """Support contacts with their first e-mail and a column per phone and e-mail type."""
    clean = normalized(contacts, SUPPORT)
    emails, types, phones = (
        f"{SUPPORT}{n}" for n in ("emails", "email_types", "phone_types")
    )
    clean = clean.withColumns(
        {emails: first_item(named(emails)), types: distinct_items(named(types))}
    )
    for column, names in ((phones, PHONE_TYPES), (types, EMAIL_TYPES)):
        flagged = indicators(clean, column, list(names), prefix="__")
        clean = flagged.withColumnsRenamed({f"__{v}": name for v, name in names.items()})
    return clean
