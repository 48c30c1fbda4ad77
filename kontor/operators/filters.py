"""Search, filters, worklists, export selection."""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontor import vocab as V
from kontor.functions import address as A
from kontor.functions import text as T
from kontor.functions import web as U
from kontor.operators.common import attach, data_columns, first_column, keep_first, keep_where, one_per_key, one_row, present, total

KEY = (V.NAME, V.CITY)


def _any(predicates: Sequence[Column]) -> Column:
    return functools.reduce(operator.or_, predicates)


def _all(predicates: Sequence[Column]) -> Column:
    return functools.reduce(operator.and_, predicates, F.lit(True))


def search(df: DataFrame, text: str, *, literal: bool = False) -> DataFrame:
    """Rows where any column contains the lower-cased pattern (F1); NULL reads as '' (deviation T1)."""
    pattern = text.strip().lower()
    if not pattern:
        return df
    cells = [F.lower(T.as_text(F.col(f"`{c}`"))) for c in data_columns(df)]
    return df.filter(_any([F.contains(c, F.lit(pattern)) if literal else c.rlike(pattern) for c in cells]))


def status_predicate(column: Column, key: str) -> Column:
    if key not in V.STATUS_FILTERS:
        raise ValueError(f"Unbekannter Statusfilter: {key}")
    allowed = V.STATUS_FILTERS[key]
    return F.lit(True) if allowed is None else T.normalize_status(column).isin(*allowed)


def status_filter(df: DataFrame, key: str, column: str = "STATUS") -> DataFrame:
    """Exact membership of the normalised status (F2)."""
    return df.filter(status_predicate(present(df, column), key))


def priority_filter(df: DataFrame, priority: str) -> DataFrame:
    """Equality on the priority."""
    return df.filter(T.as_text(present(df, "PRIORITÄT")) == priority)


def _contains_folded(column: Column, text: str) -> Column:
    return F.contains(T.casefold(T.as_text(column)), F.lit(text.casefold()))


def tag_filter(df: DataFrame, tag: str) -> DataFrame:
    """Case-insensitive literal substring of the tags."""
    return df.filter(_contains_folded(present(df, "TAGS"), tag))


def followups_only(df: DataFrame) -> DataFrame:
    """Rows with a next follow-up."""
    return df.filter(~T.is_blank(present(df, "NÄCHSTE_WIEDERVORLAGE")))


def score_predicate(df: DataFrame, choice: str) -> Column:
    analyzed = ~T.is_blank(present(df, "ANALYZED_AT"))
    if choice == "Nicht analysiert":
        return ~analyzed
    if choice == "Ohne Impressum":
        return analyzed & ~_flag(df, "HAS_IMPRINT")
    return T.as_text(present(df, "WEBSITE_SCORE_CATEGORY")) == choice


def _flag(df: DataFrame, name: str) -> Column:
    column = F.col(name).try_cast("boolean") if name in df.columns else F.lit(False)
    return F.coalesce(column, F.lit(False))


def score_filter(df: DataFrame, choice: str) -> DataFrame:
    """Score category, 'Nicht analysiert' or 'Ohne Impressum' (F6)."""
    return df.filter(score_predicate(df, choice))


def industry_filter(df: DataFrame, text: str) -> DataFrame:
    """Case-insensitive literal substring of the industry."""
    return df.filter(_contains_folded(present(df, "INDUSTRY"), text))


def social_filter(df: DataFrame, with_links: bool) -> DataFrame:
    """With or without social-media links (F8)."""
    return df.filter(T.is_blank(present(df, "SOCIAL_MEDIA")) != F.lit(with_links))


def hours_filter(df: DataFrame, with_hours: bool) -> DataFrame:
    """With or without opening hours."""
    return df.filter(_flag(df, "HAS_OPENING_HOURS") == F.lit(with_hours))


def timestamp(column: Column) -> Column:
    """ISO text to a timestamp in the session zone (UTC), NULL when unparsable."""
    return T.as_text(column).try_cast("timestamp")


def age_predicate(column: Column, days: int, now: str) -> Column:
    """Older than n days, or without a parsable date."""
    limit = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days))
    return F.coalesce(timestamp(column) < limit, F.lit(True))


def analysis_age_filter(df: DataFrame, days: int, now: str) -> DataFrame:
    return df.filter(age_predicate(present(df, "ANALYZED_AT"), days, now))


def filtered_customers(df: DataFrame, filters: Mapping[str, object], now: str) -> DataFrame:
    """Conjunction of search and all chosen filters as one predicate."""
    found = search(df, str(filters.get("text", "")))
    chosen: list[Column] = []
    if filters.get("followups_only") and "NÄCHSTE_WIEDERVORLAGE" in df.columns:
        chosen.append(~T.is_blank(F.col("NÄCHSTE_WIEDERVORLAGE")))
    if filters.get("status", "all") != "all":
        chosen.append(status_predicate(present(df, "STATUS"), str(filters["status"])))
    if filters.get("priority") and "PRIORITÄT" in df.columns:
        chosen.append(T.as_text(F.col("PRIORITÄT")) == filters["priority"])
    if filters.get("tag") and "TAGS" in df.columns:
        chosen.append(_contains_folded(F.col("TAGS"), str(filters["tag"])))
    if filters.get("score"):
        chosen.append(score_predicate(df, str(filters["score"])))
    if filters.get("industry"):
        chosen.append(_contains_folded(present(df, "INDUSTRY"), str(filters["industry"])))
    if filters.get("social") is not None:
        chosen.append(T.is_blank(present(df, "SOCIAL_MEDIA")) != F.lit(filters["social"]))
    if filters.get("hours") is not None:
        chosen.append(_flag(df, "HAS_OPENING_HOURS") == F.lit(filters["hours"]))
    if filters.get("age_days"):
        chosen.append(age_predicate(present(df, "ANALYZED_AT"), int(filters["age_days"]), now))
    return found.filter(_all(chosen))


def missing_predicate(df: DataFrame, name: str) -> Column:
    """NULL or blank; a missing column makes every row missing."""
    return T.is_blank(F.col(f"`{name}`")) if name in df.columns else F.lit(True)


def missing(df: DataFrame, name: str) -> DataFrame:
    return df.filter(missing_predicate(df, name))


def inactive_worklist(df: DataFrame) -> DataFrame:
    """First row per (name, city) with status inactive or not found; none without a status column."""
    hit = T.normalize_status(F.col("STATUS")).isin("nicht aktiv", "nicht gefunden") if "STATUS" in df.columns else F.lit(False)
    return keep_first(df.filter(hit), KEY)


def selected(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose exact (name, city) is in the key set."""
    wanted = keys.select(*[T.as_text(F.col(k)).alias(f"__{k}") for k in KEY]).dropDuplicates()
    condition = [T.as_text(present(df, k)) == F.col(f"__{k}") for k in KEY]
    return df.join(wanted, condition, "left_semi")


def only_new(df: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows whose exact key is not in the company cache."""
    known = cache.select(T.as_text(F.col("company_name")).alias("__n"), T.as_text(F.col("city")).alias("__c"))
    return df.join(known, [T.as_text(present(df, V.NAME)) == F.col("__n"), T.as_text(present(df, V.CITY)) == F.col("__c")],
                   "left_anti")


def export_select(df: DataFrame, scope: str, keys: DataFrame | None = None) -> DataFrame:
    """Rows of an export scope."""
    if scope not in V.EXPORT_SCOPES:
        raise ValueError("Unbekannter Exportumfang")
    if scope == "selected":
        return df.filter(F.lit(False)) if keys is None else selected(df, keys)
    key = V.EXPORT_SCOPES[scope]
    if key is None:
        return df
    return status_filter(df, key) if "STATUS" in df.columns else df.filter(F.lit(False))


def export_columns(df: DataFrame, *, crm: bool = True, enrichment: bool = True, technical: bool = False) -> DataFrame:
    """Ordered allow-list projection (F16)."""
    if technical:
        return df
    allowed = V.STANDARD_COLUMNS + (V.CRM_COLUMNS if crm else ()) + (V.ENRICHMENT_COLUMNS if enrichment else ())
    return df.select(*[F.col(f"`{c}`") for c in allowed if c in df.columns])


def export_preview(df: DataFrame, visible: DataFrame, chosen: DataFrame, *, nothing_marked: bool = False) -> DataFrame:
    """Counts before an export and the hint shown for an empty choice."""
    count = F.count(F.lit(1))
    counts = one_row(df.agg(count.alias("total")), visible.agg(count.alias("visible")), chosen.agg(count.alias("selected")))
    hint = F.when(F.lit(nothing_marked), "Bitte markieren Sie mindestens einen Kunden.").when(
        F.col("selected") == 0, "Für die gewählte Auswahl sind keine Datensätze vorhanden.").otherwise("")
    return counts.withColumn("message", hint)


def older_than(last_check: Column, cutoff: str) -> Column:
    """Blank or not 'yyyy-MM-dd HH:mm' counts as old."""
    checked = F.try_to_timestamp(last_check, F.lit("yyyy-MM-dd HH:mm"))
    return F.coalesce(checked < F.lit(cutoff).cast("timestamp"), F.lit(True))


def is_current(analyzed_at: Column, now: str, days: int = V.ANALYSIS_MAX_AGE_DAYS) -> Column:
    """ISO instant not older than n days; unparsable text is not current."""
    limit = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days))
    return F.coalesce(timestamp(analyzed_at) >= limit, F.lit(False))


def cell_display(df: DataFrame) -> DataFrame:
    """Every cell without 'missing' words, postal codes as text."""
    shown = {c: A.normalize_postal_code(F.col(f"`{c}`")) if c.upper() in V.POSTAL_COLUMNS
             else T.clean_missing(F.col(f"`{c}`")) for c in data_columns(df)}
    return df.withColumns(shown)


def with_valid_website(df: DataFrame, column: str = "WEBSITE", out: str = "valid_website") -> DataFrame:
    """Usable website of a customer row, document links give '' (F25)."""
    return U.with_valid_website(df, F.col(column), out)


def research_worklist(df: DataFrame, options: Mapping[str, object], cache: DataFrame | None = None,
                      now: str | None = None) -> DataFrame:
    """Rows meeting any chosen criterion, first per (name, city); no criterion keeps all."""
    criteria: list[Column] = []
    if options.get("only_new") or options.get("older_than"):
        unique = one_per_key(cache, [T.as_text(F.col("company_name")), T.as_text(F.col("city"))], "id" if "id" in cache.columns else "last_check")
        known = unique.select(T.as_text(F.col("company_name")).alias("__n"), T.as_text(F.col("city")).alias("__c"),
                              F.col("last_check").alias("__checked"), F.lit(True).alias("__known"))
        names = [T.as_text(present(df, k)) for k in KEY]
        df = df.join(known, (names[0] == F.col("__n")) & (names[1] == F.col("__c")), "left").drop("__n", "__c")
    if options.get("only_new"):
        criteria.append(F.col("__known").isNull())
    for option, name in (("no_website", "WEBSITE"), ("no_phone", "TELEFON"), ("no_email", "EMAIL")):
        if options.get(option):
            criteria.append(missing_predicate(df, name))
    if options.get("not_found"):
        criteria.append(status_predicate(F.col("STATUS"), "not_found") if "STATUS" in df.columns else F.lit(False))
    if options.get("older_than"):
        limit = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(int(options.get("older_days", 30))))
        checked = F.try_to_timestamp("__checked", F.lit("yyyy-MM-dd HH:mm"))
        criteria.append(F.coalesce(checked < limit, F.lit(True)))
    chosen = df.filter(_any(criteria)) if criteria else df
    return keep_first(chosen.drop("__known", "__checked"), KEY)


def enrichment_candidates(df: DataFrame, scope: str, now: str, age_days: int = V.ANALYSIS_MAX_AGE_DAYS) -> DataFrame:
    analyzed = ~T.is_blank(present(df, "ANALYZED_AT"))
    predicates = {
        "missing": ~analyzed,
        "older": analyzed & ~is_current(present(df, "ANALYZED_AT"), now, age_days),
        "weak": T.casefold(T.as_text(present(df, "WEBSITE_SCORE_CATEGORY"))) == "schwach",
        "error": T.casefold(T.as_text(present(df, "ENRICHMENT_STATUS"))) == "fehler",
    }
    with_site = df.filter(~T.is_blank(F.col("WEBSITE"))) if "WEBSITE" in df.columns else df.filter(F.lit(False))
    return with_site.filter(predicates.get(scope, F.lit(True)))


def enrichment_worklist(df: DataFrame, scope: str, now: str, *, age_days: int = V.ANALYSIS_MAX_AGE_DAYS,
                        force_refresh: bool = False) -> DataFrame:
    """Customers to analyse in a scope, first per id and key, current ones left out unless forced.

    For the scopes visible and selected pass the filtered or semi-joined frame.
    """
    candidates = enrichment_candidates(df, scope, now, age_days)
    if not force_refresh and scope != "older":
        candidates = candidates.filter(~is_current(present(df, "ANALYZED_AT"), now))
    return keep_first(candidates, (*V.ID_COLUMNS, *KEY))


def worklist_preview(total_rows: DataFrame, source: DataFrame, chosen: DataFrame) -> DataFrame:
    """Total, source, selected and skipped counts with the duration estimate as text."""
    count = F.count(F.lit(1))
    counts = one_row(total_rows.agg(count.alias("total")), source.agg(count.alias("source")),
                     chosen.agg(count.alias("selected"))).withColumn(
        "skipped", F.greatest(F.lit(0), F.col("source") - F.col("selected")))
    return counts.withColumn("estimate", duration_text(F.col("selected")))


def duration_text(companies: Column) -> Column:
    seconds = companies * V.SECONDS_PER_COMPANY
    minutes = F.floor(seconds / 60)
    hours = F.floor(minutes / 60)
    return (
        F.when(seconds < 60, "unter 1 Minute")
        .when(minutes == 1, "ca. 1 Minute")
        .when(minutes < 60, F.concat(F.lit("ca. "), minutes.cast("string"), F.lit(" Minuten")))
        .otherwise(F.concat(F.lit("ca. "), hours.cast("string"), F.lit(" Std. "),
                            (minutes - hours * 60).cast("string"), F.lit(" Min."))))


def cleanup_filter(items: DataFrame, mode: str) -> DataFrame:
    """Phone clean-up rows: all, invalid, changed or status."""
    if mode == "all":
        return items
    return keep_where(items, {"invalid": F.col("rating") == "ungültig", "changed": F.col("before") != F.col("after"),
                              "status": F.col("status_before") != F.col("status_after")}[mode])
