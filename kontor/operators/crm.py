"""CRM data and activities (J1, J3-J5, J10b, J18, F17, A5, O3, O4, SK8-SK11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kontor import vocab as V
from kontor.functions import text as T
from kontor.operators.common import attach, one_per_key, one_row, present, total


def _exact_key(df: DataFrame) -> list[Column]:
    return [T.strip(T.as_text(present(df, V.NAME))), T.strip(T.as_text(present(df, V.CITY)))]


def with_crm(customers: DataFrame, companies: DataFrame) -> DataFrame:
    """Ten CRM columns by exact trimmed name and city; defaults where no company matches."""
    stored = one_per_key(companies, ["company_name", F.coalesce("city", F.lit(""))]).select(
        F.col("company_name").alias("__n"), F.coalesce("city", F.lit("")).alias("__c"), F.lit(True).alias("__hit"),
        *[F.col(f).alias(f"__{f}") for f in V.CRM_DEFAULTS])
    name, city = _exact_key(customers)
    joined = customers.join(stored, (name == F.col("__n")) & (city == F.col("__c")), "left")
    labelled = {
        label: F.when(F.col("__hit"), T.strip(T.as_text(F.col(f"__{field}")))).otherwise(V.CRM_DEFAULTS[field])
        for field, label in V.CRM_LABELS.items()}
    return joined.withColumns(labelled).drop("__n", "__c", "__hit", *[f"__{f}" for f in V.CRM_DEFAULTS])


def apply_crm(customers: DataFrame, crm: DataFrame, *, complete_follow_up: bool = False) -> DataFrame:
    """Overwrite the CRM columns a frame already has, by exact (name, city).

    Completing a follow-up also blanks the next date.
    """
    unique = one_per_key(crm, [T.as_text(F.col("company_name")), T.as_text(F.col("city"))], "id" if "id" in crm.columns else "company_name")
    new = unique.select(
        T.as_text(F.col("company_name")).alias("__n"), T.as_text(F.col("city")).alias("__c"), F.lit(True).alias("__hit"),
        *[F.col(f).alias(f"__{f}") for f in V.CRM_DEFAULTS])
    joined = customers.join(
        new, (T.as_text(present(customers, V.NAME)) == F.col("__n")) & (T.as_text(present(customers, V.CITY)) == F.col("__c")), "left")
    updates = {}
    for field, label in V.CRM_LABELS.items():
        if label in customers.columns:
            value = T.as_text(F.col(f"__{field}"))
            if complete_follow_up and field == "next_follow_up_at":
                value = F.lit("")
            updates[label] = F.when(F.col("__hit"), value).otherwise(F.col(label))
    return joined.withColumns(updates).select(*customers.columns)


def activity_timeline(companies: DataFrame, activities: DataFrame) -> DataFrame:
    """Activities of every company, newest first.

    The OR of the two link rules is a union of two equi-joins, so neither becomes a nested loop.
    """
    keyed = companies.select(F.col("id").alias("for_company"), T.company_key(F.col("company_name"), F.col("city")).alias("__key"))
    by_id = activities.join(keyed.drop("__key"), F.col("company_id") == F.col("for_company"))
    by_key = activities.filter("company_id IS NULL").join(keyed, F.col("company_key") == F.col("__key")).drop("__key")
    return timeline_order(by_id.unionByName(by_key))


def timeline_order(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("occurred_at"), F.desc("id"))


def with_activity_count(companies: DataFrame, activities: DataFrame) -> DataFrame:
    """Activities per company id, 0 where there are none."""
    counts = activities.filter("company_id IS NOT NULL").groupBy(F.col("company_id").alias("id")).agg(
        F.count(F.lit(1)).alias("activity_count"))
    return companies.join(counts, "id", "left").withColumn("activity_count", F.coalesce("activity_count", F.lit(0)))


def link_orphans(activities: DataFrame, companies: DataFrame) -> DataFrame:
    """Fill a missing company id by exact name and city."""
    known = companies.groupBy(F.col("company_name").alias("__n"), F.coalesce("city", F.lit("")).alias("__c")).agg(F.min("id").alias("__id"))
    joined = activities.join(
        known, F.col("company_id").isNull() & (F.col("company_name") == F.col("__n"))
        & (F.coalesce("city", F.lit("")) == F.col("__c")), "left")
    return joined.withColumn("company_id", F.coalesce("company_id", "__id")).drop("__n", "__c", "__id")


def due_follow_ups(activities: DataFrame, now: str) -> DataFrame:
    """Follow-ups due at ``now``, oldest first."""
    due = activities.filter(~T.is_blank(F.col("follow_up_at")) & (F.col("follow_up_at") <= F.lit(now)))
    return due.orderBy(F.asc("follow_up_at"), F.asc("id"))


def crm_counts(companies: DataFrame, activities: DataFrame, now: str) -> DataFrame:
    """Follow-ups, stages, priority and today's activities in one row (A5).

    Overdue compares timestamps, not differently formatted texts (deviation T7).
    """
    open_ = ~T.is_blank(F.col("follow_up_at"))
    instant = F.lit(now).cast("timestamp")
    from_activities = activities.agg(
        total(open_).alias("open_follow_ups"),
        total(open_ & (F.col("follow_up_at").try_cast("timestamp") <= instant)).alias("overdue_follow_ups"),
        total(F.startswith("occurred_at", F.lit(now[:10]))).alias("today_activities"))
    from_companies = companies.agg(
        total(F.col("customer_stage") == "Interessent").alias("prospects"),
        total(F.col("customer_stage") == "Kunde").alias("customers"),
        total(F.col("priority") == "Hoch").alias("high_priority"))
    return one_row(from_activities, from_companies)


def deletable(companies: DataFrame, activities: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split a delete request into the remaining companies and the refused ids."""
    used = activities.filter("company_id IS NOT NULL").select(F.col("company_id").alias("id"))
    refused = ids.join(used, "id", "left_semi")
    accepted = ids.join(used, "id", "left_anti")
    return companies.join(accepted, "id", "left_anti"), refused


def save_crm(companies: DataFrame, changes: DataFrame, now: str) -> DataFrame:
    """Insert missing companies and overwrite the ten CRM fields; absent fields fall back to defaults (SK8)."""
    from kontor.sources.tables import upsert

    filled = changes.withColumns({
        "company_name": T.strip(T.as_text(F.col("company_name"))), "city": T.strip(T.as_text(F.col("city"))),
        **{f: T.strip(F.coalesce(F.col(f).cast("string"), F.lit(d)) if f in changes.columns else F.lit(d))
           for f, d in V.CRM_DEFAULTS.items()}})
    return upsert(companies, filled, ["company_name", "city"], list(V.CRM_DEFAULTS), now)


def add_activities(activities: DataFrame, companies: DataFrame, batch: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Append validated activities and create the companies they name (SK9): (activities, companies).

    A blank type becomes 'Sonstiges', an unknown one is an error. New ids continue after the largest one.
    """
    from kontor.sources.tables import next_ids

    kind = T.strip(T.as_text(F.col("activity_type")))
    kind = F.when(kind == "", "Sonstiges").otherwise(kind)
    checked = F.when(kind.isin(*V.ACTIVITY_TYPES), kind).otherwise(
        F.raise_error(F.lit("Ungültiger Aktivitätstyp")).cast("string"))
    occurred = T.strip(T.as_text(F.col("occurred_at")))
    clean = batch.withColumns({
        "company_name": T.strip(T.as_text(F.col("company_name"))), "city": T.strip(T.as_text(F.col("city"))),
        "activity_type": checked,
        "occurred_at": F.when(occurred == "", F.lit(now[:16])).otherwise(occurred),
        "subject": T.strip(T.as_text(F.col("subject"))), "description": T.strip(T.as_text(F.col("description"))),
        "follow_up_at": T.or_null(T.strip(T.as_text(F.col("follow_up_at")))),
        "created_at": F.lit(now)})
    named = companies.select("company_name", F.coalesce("city", F.lit("")).alias("city"))
    fresh = clean.select("company_name", "city").dropDuplicates().join(named, ["company_name", "city"], "left_anti")
    fresh = next_ids(fresh, companies, ["company_name", "city"]).withColumns(
        {"created_at": F.lit(now), "updated_at": F.lit(now), "customer_stage": F.lit("Interessent"), "priority": F.lit("Normal")})
    everyone = companies.unionByName(fresh.select(*[c for c in fresh.columns if c in companies.columns]), allowMissingColumns=True)
    ids = everyone.groupBy("company_name", F.coalesce("city", F.lit("")).alias("city")).agg(F.min("id").alias("company_id"))
    linked = clean.drop("company_id").join(ids, ["company_name", "city"]).withColumn(
        "company_key", T.company_key(F.col("company_name"), F.col("city")))
    order = [c for c in ("batch_no", "occurred_at", "company_name", "city", "subject") if c in linked.columns]
    numbered = next_ids(linked.drop("id"), activities, order)
    return activities.unionByName(numbered.select(*[c for c in activities.columns if c in numbered.columns]),
                                  allowMissingColumns=True), everyone


_EDITABLE = ("activity_type", "subject", "description", "occurred_at", "follow_up_at")


def update_activities(activities: DataFrame, changes: DataFrame) -> DataFrame:
    """Overwrite the given editable columns by id; NULL in a change means 'not given' (SK10)."""
    fields = [c for c in _EDITABLE if c in changes.columns]
    new = changes.select("id", *[T.strip(F.col(c)).alias(f"__{c}") for c in fields])
    joined = activities.join(new, "id", "left")
    updates = {c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in fields}
    if "activity_type" in fields:
        given = F.col("__activity_type")
        updates["activity_type"] = F.when(given.isNull(), F.col("activity_type")).when(
            given.isin(*V.ACTIVITY_TYPES), given).otherwise(
            F.raise_error(F.lit("Ungültiger Aktivitätstyp")).cast("string"))
    return joined.withColumns(updates).select(*activities.columns)


def delete_activities(activities: DataFrame, ids: DataFrame) -> DataFrame:
    return activities.join(ids.select("id"), "id", "left_anti")


def complete_follow_ups(activities: DataFrame, keys: DataFrame) -> DataFrame:
    """Clear open follow-ups of the given company keys; ``completed`` marks the affected rows (SK11)."""
    wanted = keys.select(F.col("company_key")).dropDuplicates().withColumn("__hit", F.lit(True))
    joined = activities.join(wanted, "company_key", "left")
    hit = F.col("__hit").isNotNull() & F.col("follow_up_at").isNotNull()
    return joined.withColumns({
        "completed": hit, "follow_up_at": F.when(hit, F.lit(None)).otherwise(F.col("follow_up_at"))}).drop("__hit")
