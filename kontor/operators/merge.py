"""Stored-company duplicates and phone clean-up."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontor import vocab as V
from kontor.functions import contacts as C
from kontor.functions import text as T
from kontor.functions import web as U
from kontor.operators.common import attach, non_blank, present, total
from kontor.operators.crm import with_activity_count
from kontor.session import written

_CONFLICTING = tuple(f for f in V.MERGE_FIELDS if f not in V.MERGE_NOT_CONFLICTING)
GROUP = ("n_name", "n_city")


def _trimmed(name: str) -> Column:
    return T.or_null(T.strip(T.as_text(F.col(name))))


def _ranked(companies: DataFrame, activities: DataFrame) -> DataFrame:
    """Companies with group key and master rank."""
    rows = with_activity_count(companies, activities)
    rows = C.with_phone(rows, F.col("phone"), "v_phone")
    rows = U.with_clean_url(rows, F.col("website"), "v_site")
    filled = sum((F.when(_trimmed(f).isNotNull(), 1).otherwise(0) for f in V.MERGE_FIELDS), F.lit(0))
    yes = lambda c: F.when(c, 0).otherwise(1)
    rank = F.struct(
        yes(F.col("activity_count") > 0).alias("active"),
        yes(T.casefold(T.as_text(F.col("status"))) == "vollständig").alias("complete"),
        yes((F.col("v_phone") != "") & (C.email(F.col("email")) != "")).alias("both"),
        yes(F.col("v_site") != "").alias("site"), (-filled).alias("filled"), F.col("id").alias("id"))
    return rows.withColumns({
        "n_name": T.norm_name(F.col("company_name")), "n_city": T.norm_name(F.col("city")), "rank": rank}).drop(
        "v_phone", "v_phone_reason", "v_phone_type", "v_site")


def _conflicts() -> Column:
    """Fields with more than one distinct non-blank value, found with two bounds per field."""
    return F.array_sort(F.array_compact(F.array(*[
        F.when(F.min(_trimmed(f)) != F.max(_trimmed(f)), F.lit(f)) for f in _CONFLICTING])))


def company_groups(companies: DataFrame, activities: DataFrame) -> DataFrame:
    """Stored companies sharing a normalised (name, city): master, conflicts, exactness."""
    return _grouped(_ranked(companies, activities))


def _grouped(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("size"), F.min("id").alias("group_id"),
        F.min("rank").getField("id").alias("master_id"), _conflicts().alias("conflicts")).filter("size > 1").withColumn(
        "exact", F.size("conflicts") == 0)


def company_conflicts(companies: DataFrame) -> DataFrame:
    """The differing values per group and field, sorted."""
    keyed = companies.withColumns({"n_name": T.norm_name(F.col("company_name")), "n_city": T.norm_name(F.col("city"))})
    # dealt out before the fields explode: a task holds the values of one partition, not of a whole file
    values = keyed.select(*GROUP, *_CONFLICTING).repartition(*GROUP).select(*GROUP, F.inline(F.array(*[
        F.struct(F.lit(f).alias("field"), _trimmed(f).alias("value")) for f in _CONFLICTING])))
    distinct = values.filter("value IS NOT NULL").dropDuplicates([*GROUP, "field", "value"])
    listed = distinct.groupBy(*GROUP, "field").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("value")).alias("values"))
    return listed.filter("n > 1").drop("n")


def auto_mergeable(groups: DataFrame) -> DataFrame:
    """Conflict-free groups and the rows a merge would remove (F32)."""
    return groups.filter("exact").withColumn("removed", F.col("size") - 1)


def unresolved(groups: DataFrame, resolutions: DataFrame | None) -> DataFrame:
    """Conflicting fields of a group without a resolution."""
    if resolutions is None:
        return groups.withColumn("unresolved", F.col("conflicts"))
    settled = resolutions.groupBy("group_id").agg(F.collect_set("field").alias("__fields"))
    joined = groups.join(settled, "group_id", "left")
    empty = F.array().cast("array<string>")
    return joined.withColumn(
        "unresolved", F.array_except("conflicts", F.coalesce("__fields", empty))).drop("__fields")


def _distinct_text(members: DataFrame, source: Column, fold: bool, separator: str, out: str) -> DataFrame:
    """Distinct parts per group in first-seen order, joined to one text.

    Repeats are removed before anything is collected, so a group only gathers what its result shows.
    """
    parts = members.select("master_id", "id", F.posexplode(source).alias("pos", "part"))
    parts = parts.withColumn("part", T.strip(F.col("part"))).filter("part <> ''")
    key = T.casefold(F.col("part")) if fold else F.col("part")
    place = F.struct("id", "pos")
    firsts = parts.groupBy("master_id", key.alias("key")).agg(
        F.min(place).alias("place"), F.min_by("part", place).alias("part"))
    ordered = F.array_sort(F.collect_list(F.struct("place", "part")))
    return firsts.groupBy("master_id").agg(ordered.alias("__list")).select(
        "master_id", F.array_join(F.transform("__list", lambda x: x["part"]), separator).alias(out))


def merge_companies(companies: DataFrame, activities: DataFrame, resolutions: DataFrame | None = None,
                    now: str = "") -> dict[str, DataFrame]:
    """Merge every group of stored companies into its master.

    ``resolutions`` has group_id, field, value. Returns the new companies, the re-pointed activities and
    the groups that were left alone because a conflict has no resolution.
    """
    # every branch below starts from the stored rows: names are normalised and ranked once, not once a branch
    ranked = written(_ranked(companies, activities), "ranked")
    groups = unresolved(_grouped(ranked), resolutions)
    ready = groups.filter(F.size("unresolved") == 0)
    rejected = groups.filter(F.size("unresolved") > 0)
    members = attach(ranked.drop("rank", "activity_count"), ready.select(*GROUP, "master_id", "group_id"), GROUP, "inner").drop(*GROUP)

    firsts = members.groupBy("master_id", "group_id").agg(
        *[F.min_by(_trimmed(f), F.when(_trimmed(f).isNotNull(), F.col("id"))).alias(f)
          for f in V.MERGE_FIELDS if f not in V.MERGE_NOT_CONFLICTING],
        F.coalesce(F.max(non_blank(F.col("last_contact_at"))), F.lit("")).alias("last_contact_at"),
        F.coalesce(F.min(non_blank(F.col("next_follow_up_at"))), F.lit("")).alias("next_follow_up_at"))
    if resolutions is not None:
        chosen = resolutions.groupBy("group_id").agg(*[
            F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"__{f}") for f in _CONFLICTING])
        firsts = firsts.join(chosen, "group_id", "left").withColumns({
            f: F.coalesce(F.col(f"__{f}"), F.col(f)) for f in _CONFLICTING}).drop(*[f"__{f}" for f in _CONFLICTING])
    firsts = firsts.fillna("", subset=list(_CONFLICTING))
    for field in ("phone", "direct_phone"):
        firsts = C.with_phone(firsts, F.col(field), f"v_{field}")
    firsts = U.with_clean_url(firsts, F.col("website"), "v_website").withColumns({
        "email": C.email(F.col("email")), "direct_email": C.email(F.col("direct_email"))}).withColumns({
            f: F.col(f"v_{f}") for f in ("phone", "direct_phone", "website")}).drop(
        "v_website", *[f"v_{f}{s}" for f in ("phone", "direct_phone") for s in ("", "_reason", "_type")])
    tags = _distinct_text(members, F.split(T.as_text(F.col("tags")), "[,;]"), True, ", ", "tags")
    notes = _distinct_text(members, F.array(T.as_text(F.col("notes"))), False, V.NOTES_SEPARATOR, "notes")
    merged = firsts.join(tags, "master_id", "left").join(notes, "master_id", "left").fillna("", subset=["tags", "notes"])

    renamed = merged.select(F.col("master_id").alias("id"), *[F.col(f).alias(f"__{f}") for f in V.MERGE_FIELDS], F.lit(True).alias("__hit"))
    removed = members.filter("id <> master_id").select("id")
    kept = companies.join(removed, "id", "left_anti").join(renamed, "id", "left")
    updates = {f: F.when(F.col("__hit"), F.col(f"__{f}")).otherwise(F.col(f)) for f in V.MERGE_FIELDS}
    if now and "updated_at" in companies.columns:
        updates["updated_at"] = F.when(F.col("__hit"), F.lit(now)).otherwise(F.col("updated_at"))
    masters = members.filter("id = master_id").select(
        "master_id", F.col("company_name").alias("master_name"), F.coalesce("city", F.lit("")).alias("master_city"))
    mapping = members.select(
        "id", T.company_key(F.col("company_name"), F.col("city")).alias("company_key"), "master_id").join(masters, "master_id")
    return {"companies": kept.withColumns(updates).select(*companies.columns),
            "activities": repoint_activities(activities, mapping), "rejected": rejected}


def repoint_activities(activities: DataFrame, mapping: DataFrame) -> DataFrame:
    """Activities of merged ids, or of their keys, move to the master.

    Two equi-joins instead of an OR; a match by id wins, which leads to the same group as one by key.
    """
    by_id = mapping.select(F.col("id").alias("company_id"), *[
        F.col(c).alias(f"__i_{c}") for c in ("master_id", "master_name", "master_city")])
    by_key = mapping.groupBy("company_key").agg(*[
        F.min_by(c, "id").alias(f"__k_{c}") for c in ("master_id", "master_name", "master_city")])
    joined = activities.join(by_id, "company_id", "left").join(by_key, "company_key", "left")
    pick = lambda c: F.when(F.col("__i_master_id").isNotNull(), F.col(f"__i_{c}")).otherwise(F.col(f"__k_{c}"))
    moved = pick("master_id").isNotNull()
    updates = {
        "company_id": F.coalesce(pick("master_id"), F.col("company_id")),
        "company_key": F.when(moved, T.company_key(pick("master_name"), pick("master_city"))).otherwise(F.col("company_key")),
        "company_name": F.when(moved, pick("master_name")).otherwise(F.col("company_name")),
        "city": F.when(moved, pick("master_city")).otherwise(F.col("city"))}
    return joined.withColumns(updates).select(*activities.columns)


def phone_cleanup_preview(companies: DataFrame) -> DataFrame:
    """Phone before and after, rating, reason and recomputed status per company."""
    rows = C.with_phone(companies, F.col("phone"), "after")
    rating = F.when(F.col("after") != "", "gültig").when(T.is_blank(F.col("phone")), "leer").otherwise("ungültig")
    status = C.contact_status(F.col("website"), F.col("after") != "", C.email(F.col("email")) != "")
    return rows.select(
        F.col("id").alias("company_id"), F.col("company_name").alias("company"), T.as_text(F.col("city")).alias("city"),
        T.as_text(F.col("phone")).alias("before"), "after", rating.alias("rating"), F.col("after_reason").alias("reason"),
        T.as_text(F.col("status")).alias("status_before"), status.alias("status_after"))


def phone_cleanup_apply(companies: DataFrame, items: DataFrame, now: str = "") -> DataFrame:
    """Write cleaned phone and status back by company id."""
    new = items.select(F.col("company_id").alias("id"), F.col("after").alias("__phone"), F.col("status_after").alias("__status"))
    joined = companies.join(new, "id", "left")
    hit = F.col("__status").isNotNull()
    updates = {"phone": F.when(hit, F.col("__phone")).otherwise(F.col("phone")),
               "status": F.when(hit, F.col("__status")).otherwise(F.col("status"))}
    if now and "updated_at" in companies.columns:
        updates["updated_at"] = F.when(hit, F.lit(now)).otherwise(F.col("updated_at"))
    return joined.withColumns(updates).select(*companies.columns)


def phone_cleanup_summary(items: DataFrame) -> DataFrame:
    """Totals of a phone clean-up."""
    return items.agg(
        F.count(F.lit(1)).alias("total"), total(F.col("rating") == "gültig").alias("valid"),
        total(F.col("rating") == "ungültig").alias("invalid"), total(F.col("before") != F.col("after")).alias("changed"),
        total(F.col("status_before") != F.col("status_after")).alias("status_changes"))


def apply_phone_cleanup(customers: DataFrame, items: DataFrame) -> DataFrame:
    """Overwrite phone and status of imported rows by exact (name, city)."""
    new = items.groupBy(F.col("company").alias("__n"), F.col("city").alias("__c")).agg(
        F.max_by("after", "company_id").alias("__phone"), F.max_by("status_after", "company_id").alias("__status"))
    joined = customers.join(
        new, (T.as_text(present(customers, V.NAME)) == F.col("__n")) & (T.as_text(present(customers, V.CITY)) == F.col("__c")), "left")
    hit = F.col("__n").isNotNull()
    return joined.withColumns({
        "TELEFON": F.when(hit, F.col("__phone")).otherwise(F.col("TELEFON")),
        "STATUS": F.when(hit, F.col("__status")).otherwise(F.col("STATUS"))}).select(*customers.columns)
