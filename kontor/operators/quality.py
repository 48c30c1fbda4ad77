"""Import quality: normalised rows, scores, issues, duplicate groups, merge and clean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontor import vocab as V
from kontor.functions import address as A
from kontor.functions import contacts as C
from kontor.functions import text as T
from kontor.functions import web as U
from kontor.operators.common import ROW_NO, attach, data_columns, first_column, non_blank, one_row, spread, total
from kontor.operators.similarity import blocked_similar, connected_components

CONFLICT_FIELDS = ("city", "address", "phone", "email", "website")
_SEP = "\x1f"


def normalize_rows(df: DataFrame) -> DataFrame:
    """Comparison forms of every row next to its data.

    Adds n_name, n_city, n_phone, n_email, n_website, n_address, n_all (all fields), n_filled, n_empty.
    """
    columns = data_columns(df)
    staged = C.with_phone(spread(df), first_column(df, V.PHONE_COLUMNS), "n_phone")
    staged = U.with_website(staged, first_column(df, V.WEBSITE_COLUMNS), "n_website")
    staged = staged.withColumns({
        "n_name": T.norm_name(F.col(V.NAME)) if V.NAME in columns else F.lit(""),
        "n_city": T.norm_name(F.col(V.CITY)) if V.CITY in columns else F.lit(""),
        "n_email": C.email(first_column(df, V.EMAIL_COLUMNS)),
        "n_address": A.street_name(first_column(df, V.STREET_COLUMNS)),
    })
    fields = []
    for name in columns:
        cell = F.col(f"`{name}`")
        fallback = T.casefold(T.cell_text(cell))
        if name in V.PHONE_COLUMNS:
            if name != next(c for c in V.PHONE_COLUMNS if c in columns):
                staged = C.with_phone(staged, cell, f"n_phone_{name}")
                value = F.col(f"n_phone_{name}")
            else:
                value = F.col("n_phone")
        elif name in V.EMAIL_COLUMNS:
            value = F.col("n_email") if name == next(c for c in V.EMAIL_COLUMNS if c in columns) else C.email(cell)
        elif name in V.WEBSITE_COLUMNS:
            if name != next(c for c in V.WEBSITE_COLUMNS if c in columns):
                staged = U.with_website(staged, cell, f"n_web_{name}")
                value = F.col(f"n_web_{name}")
            else:
                value = F.col("n_website")
        elif name.upper() in V.POSTAL_COLUMNS:
            fields.append(A.normalize_postal_code(cell))
            continue
        else:
            fields.append(F.col({V.NAME: "n_name", V.CITY: "n_city"}[name]) if name in (V.NAME, V.CITY) else T.norm_name(cell))
            continue
        fields.append(F.when(value == "", fallback).otherwise(value))
    filled = sum((F.when(T.is_blank(F.col(f"`{c}`")), 0).otherwise(1) for c in columns), F.lit(0))
    return staged.withColumns({"n_all": F.concat_ws(_SEP, *fields), "n_filled": filled}).withColumn(
        "n_empty", F.col("n_filled") == 0)


def _points() -> Column:
    """Points of a row without the share for not being a repeat."""
    weights = {"n_name": 35, "n_city": 10, "n_website": 20, "n_phone": 15, "n_email": 15}
    return sum((F.when(F.col(c) != "", w).otherwise(0) for c, w in weights.items()), F.lit(0))


def dashboard_quality(df: DataFrame) -> DataFrame:
    """Quality score, invalid contacts and repeats of (name, city) in one row (A1).

    The repeats follow from the row count per key, so a key that holds much of the table is already
    summed up on the map side and never sorted in one task.
    """
    rows = normalize_rows(df)
    phone, mail = first_column(df, V.PHONE_COLUMNS), first_column(df, V.EMAIL_COLUMNS)
    per_key = rows.groupBy("n_name", "n_city").agg(
        F.count(F.lit(1)).alias("n"), F.sum(_points()).alias("points"),
        total(~T.is_blank(phone) & (F.col("n_phone") == "")).alias("bad_phone"),
        total(~T.is_blank(mail) & (F.col("n_email") == "")).alias("bad_email"))
    repeats = F.sum(F.when(F.col("n_name") != "", F.col("n") - 1).otherwise(0))
    summed = per_key.agg(
        F.sum("n").alias("n"), F.sum("points").alias("points"), F.sum("bad_phone").alias("bad_phone"),
        F.sum("bad_email").alias("bad_email"), repeats.alias("repeats"))
    share = (F.col("points") + 5 * (F.col("n") - F.col("repeats"))) / F.col("n")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return summed.select(
        zero(F.bround(share)).alias("quality_score"), zero(F.col("bad_phone")).alias("invalid_phone"),
        zero(F.col("bad_email")).alias("invalid_email"), zero(F.col("repeats")).alias("duplicates"))


def repeat_flag(df: DataFrame) -> DataFrame:
    """Mark rows whose normalised (name, city) appeared earlier."""
    rows = df.withColumns({"n_name": T.norm_name(F.col(V.NAME)), "n_city": T.norm_name(F.col(V.CITY))})
    firsts = rows.groupBy("n_name", "n_city").agg(F.min(ROW_NO).alias("first_row"))
    return attach(rows, firsts, ["n_name", "n_city"]).withColumn(
        "repeat", (F.col("n_name") != "") & (F.col(ROW_NO) > F.col("first_row"))).drop("first_row")


def exact_duplicates(df: DataFrame) -> DataFrame:
    """All rows whose exact (name[, city]) occurs more than once, in key order."""
    keys = [c for c in (V.NAME, V.CITY) if c in df.columns]
    marked = df.withColumns({f"__{k}": F.coalesce(F.col(k), F.lit(_SEP)) for k in keys})
    names = [f"__{k}" for k in keys]
    repeated = marked.groupBy(*names).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").drop("__n")
    return sort_duplicates(attach(marked, repeated, names, "inner").drop(*names), keys)


def sort_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Ascending by the key columns, NULLs last; the row number also splits long runs of equal keys (O1)."""
    return df.orderBy(*[F.col(f"`{k}`").asc_nulls_last() for k in keys], ROW_NO)


def row_key(source: str, sheet: str) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", F.lit(source), F.lit(sheet), excel_row().cast("string")), 256), 1, 20)


def excel_row() -> Column:
    """Sheet position of a row: row numbers start at 0, data at line 2."""
    return F.col(ROW_NO) + 2


def issues(df: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """One row per finding: row number, kind, field, message, original value."""
    rows = normalize_rows(df) if rows is None else rows
    phone, mail = first_column(df, V.PHONE_COLUMNS), first_column(df, V.EMAIL_COLUMNS)
    site = first_column(df, V.WEBSITE_COLUMNS)

    def finding(condition, kind, field, message, original=F.lit("")):
        return F.when(condition, F.struct(
            F.lit(kind).alias("kind"), F.lit(field).alias("field"), F.lit(message).alias("message"),
            original.alias("original_value")))

    filled = ~F.col("n_empty")
    found = [
        finding(F.col("n_empty"), "empty_row", "", "Vollständig leere Zeile"),
        finding(filled & (F.col("n_name") == ""), "missing", V.NAME, "Kundenname fehlt"),
        finding(filled & (F.col("n_city") == ""), "missing", V.CITY, "Ort fehlt"),
        finding(filled & ~T.is_blank(phone) & (F.col("n_phone") == ""), "invalid_phone", "TELEFON",
                "Ungültige Telefonnummer", T.cell_text(phone)),
        finding(filled & ~T.is_blank(mail) & (F.col("n_email") == ""), "invalid_email", "EMAIL",
                "Ungültige E-Mail-Adresse", T.cell_text(mail)),
        finding(filled & _normalizable(site), "website_normalizable", "WEBSITE",
                "Website kann normalisiert werden", T.cell_text(site)),
    ]
    for name in (c for c in data_columns(df) if c.upper() in V.POSTAL_COLUMNS):
        raw, postal = T.cell_text(F.col(f"`{name}`")), A.normalize_postal_code(F.col(f"`{name}`"))
        decimal = raw.rlike(r"^[+-]?\d+[.,]\d+$") & ~raw.rlike(r"^.*[.,]0+$")
        found.append(finding(filled & decimal, "invalid_postal_code", name,
                             "Postleitzahl enthält einen Dezimalwert", raw))
        found.append(finding(filled & ~decimal & postal.rlike(r"^\d{1,4}$"), "short_postal_code", name,
                             "Kurze Postleitzahl; eine verlorene führende Null wird nicht ergänzt", postal))
    return rows.select(
        ROW_NO, excel_row().alias("excel_row"), F.inline(F.array_compact(F.array(*found))))


def _normalizable(site: Column) -> Column:
    return (~T.is_blank(site) & (F.col("n_website") != "")
            & (F.col("n_website") != F.rtrim(T.cell_text(site), F.lit("/"))))


def issues_view(found: DataFrame, tab: str) -> DataFrame:
    """Findings of one tab: phones, emails, websites or missing."""
    kinds = {"phones": ["invalid_phone"], "emails": ["invalid_email"],
             "websites": ["website_normalizable"], "missing": ["missing", "empty_row"]}[tab]
    return found.filter(F.col("kind").isin(kinds)).select("excel_row", "field", "message", "original_value")


def _several(column: Column) -> Column:
    """More than one distinct non-blank value in the group, with constant state per group."""
    value = F.when(column != "", column)
    return F.coalesce(F.min(value) != F.max(value), F.lit(False))


def with_texts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The texts of all cells as columns ``__t_*``: each is computed once, not once for every bound that ``group_profile`` takes."""
    return rows.withColumns({f"__t_{c}": T.text(F.col(f"`{c}`")) for c in columns})


def group_profile(columns: list[str]) -> list[Column]:
    """Aggregates over ``with_texts`` describing a duplicate group: size, first row, master (D6), conflicts (D4), differences."""
    rank = F.struct(
        F.when((F.col("n_phone") != "") & (F.col("n_email") != ""), 0).otherwise(1).alias("both"),
        F.when(F.col("n_website") != "", 0).otherwise(1).alias("site"),
        F.when(F.col("n_address") != "", 0).otherwise(1).alias("street"),
        (-F.col("n_filled")).alias("filled"), F.col(ROW_NO).alias(ROW_NO))
    conflicts = F.array_compact(F.array(*[
        F.when(_several(F.col(f"n_{f}")), F.lit(f)) for f in CONFLICT_FIELDS]))
    differences = F.array_compact(F.array(*[
        F.when(_several(F.col(f"`__t_{c}`")), F.lit(c)) for c in columns]))
    return [
        F.count(F.lit(1)).alias("size"), F.min(ROW_NO).alias("first_row"),
        F.min(rank).getField(ROW_NO).alias("master_row"),
        conflicts.alias("conflicts"), differences.alias("differences"),
        (F.min("n_all") == F.max("n_all")).alias("same"),
    ]


def _finish_groups(profiles: DataFrame, category: Column, source: str, sheet: str) -> DataFrame:
    identified = F.sha2(F.concat_ws("|", F.lit(source), F.lit(sheet), F.col("first_row").cast("string")), 256)
    return profiles.withColumn("category", category).withColumn("group_id", F.substring(identified, 1, 16)).drop("same")


def name_groups(rows: DataFrame, columns: list[str], source: str = "", sheet: str = "Tabelle1") -> DataFrame:
    """Groups of non-empty rows with one normalised name: identical, safe or unsafe (D3)."""
    # rows without a name share one group that is left out behind the aggregate: a filter in front of it would be pushed
    # below the stages of the rows and normalise every name once more
    name = F.when(F.col("n_empty"), "").otherwise(F.col("n_name"))
    profiles = with_texts(rows, columns).withColumn("n_name", name).groupBy("n_name").agg(
        *group_profile(columns), F.max(F.col("n_name") != "").alias("named")).filter("size > 1 AND named").drop("named")
    category = F.when(F.col("same"), "identical").when(F.size("conflicts") == 0, "safe").otherwise("unsafe")
    groups = _finish_groups(profiles, category, source, sheet)
    return groups.withColumn("conflicts", F.when(F.col("category") == "identical", F.array().cast("array<string>"))
                             .otherwise(F.col("conflicts")))


def similar_members(rows: DataFrame) -> DataFrame:
    """Rows of names that occur once, with the component of near-typos they belong to."""
    named = rows.filter(~F.col("n_empty") & (F.col("n_name") != ""))
    single = named.groupBy("n_name").agg(
        F.count(F.lit(1)).alias("n"), F.min(ROW_NO).alias(ROW_NO), F.min("n_city").alias("n_city")).filter("n = 1")
    return connected_components(blocked_similar(single)).withColumnsRenamed({"vertex": ROW_NO})


def similar_groups(rows: DataFrame, columns: list[str], members: DataFrame | None = None,
                   source: str = "", sheet: str = "Tabelle1") -> DataFrame:
    """Groups of similar, not equal names within one city; always unsafe."""
    members = similar_members(rows) if members is None else members
    profiles = with_texts(rows.join(members, ROW_NO), columns).groupBy("component").agg(*group_profile(columns))
    return _finish_groups(profiles, F.lit("unsafe"), source, sheet).drop("component")


def duplicate_groups(df: DataFrame, rows: DataFrame | None = None, members: DataFrame | None = None) -> DataFrame:
    """All duplicate groups of a customer table."""
    rows = normalize_rows(df) if rows is None else rows
    columns = data_columns(df)
    return name_groups(rows, columns).drop("n_name").unionByName(similar_groups(rows, columns, members))


def quality_score(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Score over non-empty rows; repeats are all group members but the first, in any category (A3)."""
    repeats = groups.agg(F.coalesce(F.sum(F.col("size") - 1), F.lit(0)).alias("repeats"))
    points = rows.filter(~F.col("n_empty")).agg(F.sum(_points() + 5).alias("points"), F.count(F.lit(1)).alias("n"))
    share = F.bround((F.col("points") - 5 * F.col("repeats")) / F.when(F.col("n") != 0, F.col("n")))
    return one_row(points, repeats).select(F.coalesce(share, F.lit(0)).cast("bigint").alias("quality_score"))


def import_summary(df: DataFrame, rows: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
    """The twelve counters of an import analysis in one row (A2)."""
    rows = normalize_rows(df) if rows is None else rows
    groups = duplicate_groups(df, rows) if groups is None else groups
    phone, mail = first_column(df, V.PHONE_COLUMNS), first_column(df, V.EMAIL_COLUMNS)
    filled = ~F.col("n_empty")
    counters = rows.agg(
        F.count(F.lit(1)).alias("total_rows"),
        total(filled & (F.col("n_name") != "")).alias("valid_records"),
        total(filled & (F.col("n_name") == "")).alias("missing_customer_name"),
        total(filled & (F.col("n_city") == "")).alias("missing_city"),
        total(filled & ~T.is_blank(phone) & (F.col("n_phone") == "")).alias("invalid_phones"),
        total(filled & ~T.is_blank(mail) & (F.col("n_email") == "")).alias("invalid_emails"),
        total(filled & (F.col("n_website") == "")).alias("empty_websites"),
        total(filled & _normalizable(first_column(df, V.WEBSITE_COLUMNS))).alias("normalizable_websites"),
        total(F.col("n_empty")).alias("empty_rows"),
        F.sum(F.when(filled, _points() + 5)).alias("points"), total(filled).alias("n"))
    grouped = groups.agg(
        F.coalesce(F.sum(F.when(F.col("category") == "identical", F.col("size") - 1)), F.lit(0)).alias("identical_duplicates"),
        total(F.col("category") != "identical").alias("similar_groups"),
        F.coalesce(F.sum(F.col("size") - 1), F.lit(0)).alias("repeats"))
    share = F.bround((F.col("points") - 5 * F.col("repeats")) / F.when(F.col("n") != 0, F.col("n")))
    return one_row(counters, grouped).withColumn(
        "quality_score", F.coalesce(share, F.lit(0)).cast("bigint")).drop("points", "n", "repeats")


def group_members(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of name groups with group_id, category and master_row next to the data."""
    return attach(rows, groups.select("n_name", "group_id", "category", "master_row", "conflicts"), ["n_name"], "inner")


def groups_view(groups: DataFrame, df: DataFrame) -> DataFrame:
    """Display row per group: label, size, first member's name and city, differences, conflicts."""
    label = (F.when(F.col("category") == "identical", "Identisch")
             .when(F.col("category") == "safe", "Sicher zusammenführbar").otherwise("Unsicher"))
    first = df.select(F.col(ROW_NO).alias("first_row"), F.col(V.NAME).alias("name"), F.col(V.CITY).alias("city"))
    return groups.join(first, "first_row").select(
        "group_id", label.alias("label"), "size", (F.col("first_row") + 2).alias("first_excel_row"),
        T.text(F.col("name")).alias("name"), T.text(F.col("city")).alias("city"),
        F.array_join("differences", ", ").alias("differences"), F.array_join("conflicts", ", ").alias("conflicts"))


def with_overrides(groups: DataFrame, rows: DataFrame, overrides: DataFrame | None) -> DataFrame:
    """Replace suggested masters by chosen ones; a choice outside its group is an error."""
    if overrides is None:
        return groups
    chosen = overrides.select("group_id", F.col("master_row").alias("wanted"))
    names = rows.select(F.col(ROW_NO).alias("wanted"), F.col("n_name").alias("wanted_name"))
    joined = groups.join(chosen, "group_id", "left").join(names, "wanted", "left")
    checked = F.when(F.col("wanted").isNull(), F.col("master_row")).when(
        F.col("wanted_name") == F.col("n_name"), F.col("wanted")).otherwise(
        F.raise_error(F.lit("Die gewählte Hauptzeile gehört nicht zur Dublettengruppe.")).cast("bigint"))
    return joined.withColumn("master_row", checked).drop("wanted", "wanted_name")


def merge_groups(df: DataFrame, overrides: DataFrame | None = None, *, remove_identical: bool = True,
                 merge_safe: bool = True, rows: DataFrame | None = None) -> DataFrame:
    """One row per identical or safe group: the master keeps its values, blanks are filled.

    Missing cells take the first non-blank value of the other members in row order. The fill-in per group
    is a fixed-size aggregate, so group size does not matter.
    """
    columns = data_columns(df)
    rows = normalize_rows(df) if rows is None else rows
    wanted = [c for c, on in (("identical", remove_identical), ("safe", merge_safe)) if on]
    groups = with_overrides(name_groups(rows, columns), rows, overrides).filter(F.col("category").isin(wanted))
    active = F.when(F.col("n_empty") | (F.col("n_name") == ""), F.lit(None)).otherwise(F.col("n_name"))
    # only the join key travels beside the original cells
    slim = rows.select(ROW_NO, *[F.col(f"`{c}`") for c in columns], active.alias("n_name"))
    tagged = attach(slim, groups.select("n_name", "master_row", "group_id"), ["n_name"])
    others = tagged.filter(F.col("master_row").isNotNull() & (F.col(ROW_NO) != F.col("master_row")))
    fills = others.groupBy(F.col("master_row").alias(ROW_NO)).agg(*[
        F.min_by(F.col(f"`{c}`"), F.when(~T.is_blank(F.col(f"`{c}`")), F.col(ROW_NO))).alias(f"fill_{i}")
        for i, c in enumerate(columns)])
    kept = tagged.filter(F.col("master_row").isNull() | (F.col(ROW_NO) == F.col("master_row")))
    joined = kept.join(fills, ROW_NO, "left")
    return joined.select(ROW_NO, *[
        F.when(T.is_blank(F.col(f"`{c}`")), F.coalesce(F.col(f"fill_{i}"), F.col(f"`{c}`")))
        .otherwise(F.col(f"`{c}`")).alias(c) for i, c in enumerate(columns)])


_COUNTERS = ("corrected_phones", "discarded_emails", "normalized_websites")


def clean_rows(df: DataFrame, *, skip_missing_customer_name: bool = True, invalid_phone_action: str = "clear",
               invalid_email_action: str = "clear", keep_counters: bool = False) -> DataFrame:
    """Canonical contacts, websites and postal codes; nameless rows are dropped."""
    columns = data_columns(df)
    staged = df.filter(~T.is_blank(F.col(V.NAME))) if skip_missing_customer_name else df
    phones, discarded, sites = F.lit(0), F.lit(0), F.lit(0)
    result = {}
    for name in columns:
        cell = F.col(f"`{name}`")
        filled = ~T.is_blank(cell)
        if name in V.PHONE_COLUMNS:
            staged = C.with_phone(staged, cell, f"v_{name}")
            valid = F.col(f"v_{name}")
            better = filled & (valid != "") & (valid != T.cell_text(cell))
            clear = filled & (valid == "") & F.lit(invalid_phone_action == "clear")
            result[name] = F.when(better, valid).when(clear, "").otherwise(cell)
            phones = phones + F.when(better | clear, 1).otherwise(0)
        elif name in V.EMAIL_COLUMNS:
            valid = C.email(cell)
            clear = filled & (valid == "") & F.lit(invalid_email_action == "clear")
            result[name] = F.when(filled & (valid != ""), valid).when(clear, "").otherwise(cell)
            discarded = discarded + F.when(clear, 1).otherwise(0)
        elif name in V.WEBSITE_COLUMNS:
            staged = U.with_website(staged, cell, f"v_{name}")
            valid = F.col(f"v_{name}")
            better = filled & (valid != "") & (valid != F.rtrim(T.cell_text(cell), F.lit("/")))
            result[name] = F.when(better, valid).otherwise(cell)
            sites = sites + F.when(better, 1).otherwise(0)
        elif name.upper() in V.POSTAL_COLUMNS:
            result[name] = A.normalize_postal_code(cell)
        else:
            result[name] = cell
    counters = [c.alias(f"__{n}") for c, n in zip((phones, discarded, sites), _COUNTERS)] if keep_counters else []
    return staged.select(ROW_NO, *[column.alias(name) for name, column in result.items()], *counters)


def import_report(df: DataFrame, overrides: DataFrame | None = None, similar: DataFrame | None = None) -> DataFrame:
    """Counters of a full cleaning run in one row."""
    rows = normalize_rows(df)
    groups = name_groups(rows, data_columns(df))
    fuzzy = similar_groups(rows, data_columns(df)) if similar is None else similar
    merged = merge_groups(df, overrides, rows=rows)
    cleaned = clean_rows(merged, keep_counters=True)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    after = cleaned.agg(F.count(F.lit(1)).alias("rows_after"), *[
        zero(F.sum(f"__{n}")).alias(n) for n in _COUNTERS])
    grouped = groups.agg(
        zero(F.sum(F.when(F.col("category") == "identical", F.col("size") - 1))).alias("removed_identical"),
        total(F.col("category") == "safe").alias("merged_groups"))
    conflicts = groups.select("conflicts").unionByName(fuzzy.select("conflicts")).agg(
        total(F.size("conflicts") > 0).alias("open_conflicts"))
    return one_row(
        df.agg(F.count(F.lit(1)).alias("rows_before")),
        merged.agg(total(T.is_blank(F.col(V.NAME))).alias("skipped_rows")), after, grouped, conflicts)


def unchanged_report(df: DataFrame, groups: DataFrame) -> DataFrame:
    """Report of the path that keeps the table as it is: all counters zero."""
    size = df.agg(F.count(F.lit(1)).alias("rows_before"), F.count(F.lit(1)).alias("rows_after"))
    zeros = {n: F.lit(0).cast("bigint") for n in (
        "removed_identical", "merged_groups", "skipped_rows", *_COUNTERS)}
    return one_row(size, groups.agg(total(F.size("conflicts") > 0).alias("open_conflicts"))).withColumns(zeros)


def analyze_import(df: DataFrame, source: str = "", sheet: str = "Tabelle1") -> dict[str, DataFrame]:
    """Rows, issues, groups and summary of one import (D9). Fails when the name column is missing."""
    if V.NAME not in df.columns:
        raise ValueError("Die Datei enthält die erforderliche Spalte KUNDENNAME nicht.")
    rows = normalize_rows(df)
    groups = duplicate_groups(df, rows)
    return {
        "rows": df.withColumns({"row_key": row_key(source, sheet), "excel_row": excel_row()}),
        "issues": issues(df, rows), "groups": groups, "summary": import_summary(df, rows, groups),
    }
