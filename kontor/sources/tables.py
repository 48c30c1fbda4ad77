"""Sources (SC1-SC7), sinks (SK1-SK5, SK13) and table updates (SK6, SK7, SK12).

Tables are immutable snapshots: an update returns the new table, writing goes to a new path.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as S

from kontor import vocab as V
from kontor.functions import address as A
from kontor.functions import text as T
from kontor.operators.common import ROW_NO, first_column, one_row, with_row_no
from kontor.session import checkpointed

CHANGE_SCHEMA = (
    "company STRING, city STRING, old_website STRING, new_website STRING, old_phone STRING, new_phone STRING, "
    "old_email STRING, new_email STRING, old_status STRING, new_status STRING, changed_fields ARRAY<STRING>, "
    "success BOOLEAN, error_message STRING")
REPORT_SCHEMA = (
    "started_at STRING, finished_at STRING, duration_seconds DOUBLE, total BIGINT, processed BIGINT, skipped BIGINT, "
    "active BIGINT, complete BIGINT, inactive BIGINT, not_found BIGINT, websites_found BIGINT, "
    "websites_corrected BIGINT, phones_found BIGINT, emails_found BIGINT, contacts_still_incomplete BIGINT, "
    "errors BIGINT, cancelled BOOLEAN, "
    f"changes ARRAY<STRUCT<{', '.join(p.strip().replace(' ', ': ', 1) for p in CHANGE_SCHEMA.split(','))}>>, "
    "error_details ARRAY<STRUCT<company: STRING, city: STRING, message: STRING>>")
IMPRINT_SCHEMA = (
    "STRUCT<owner_names: ARRAY<STRING>, managing_director_names: ARRAY<STRING>, representative_names: ARRAY<STRING>, "
    "legal_form: STRING, imprint_company_name: STRING, imprint_street: STRING, imprint_house_number: STRING, "
    "imprint_postal_code: STRING, imprint_city: STRING, imprint_country: STRING, imprint_phone: STRING, "
    "imprint_email: STRING, vat_id: STRING, commercial_register_type: STRING, commercial_register_number: STRING, "
    "register_court: STRING, imprint_extraction_confidence: DOUBLE, imprint_sources: ARRAY<STRING>, "
    "imprint_raw_label_values: MAP<STRING, STRING>, imprint_analyzed_at: STRING>")
RESULT_SCHEMA = (
    "STRUCT<company: STRING, city: STRING, website: STRING, customer_id: BIGINT, company_key: STRING, "
    "website_score: INT, website_score_category: STRING, website_score_details: STRUCT<total: INT, category: STRING, "
    "criteria: ARRAY<STRUCT<key: STRING, label: STRING, achieved: BOOLEAN, points: INT, maximum: INT>>>, "
    "has_https: BOOLEAN, ssl_valid: BOOLEAN, has_imprint: BOOLEAN, imprint_url: STRING, "
    f"imprint_data: {IMPRINT_SCHEMA}, has_privacy_policy: BOOLEAN, privacy_url: STRING, has_contact_page: BOOLEAN, "
    "contact_page_url: STRING, has_opening_hours: BOOLEAN, opening_hours: STRUCT<entries: ARRAY<STRUCT<day: STRING, "
    "periods: ARRAY<STRING>, closed: BOOLEAN, by_appointment: BOOLEAN>>, original_text: STRING, source: STRING, "
    "reliable: BOOLEAN>, social_media: STRUCT<facebook: STRING, instagram: STRING, linkedin: STRING, youtube: STRING, "
    "tiktok: STRING, x: STRING, pinterest: STRING>, industry: STRUCT<industry: STRING, confidence: DOUBLE, "
    "hints: ARRAY<STRING>, alternative: STRING>, short_description: STRING, description_sources: ARRAY<STRING>, "
    "contact_form_url: STRING, website_title: STRING, meta_description: STRING, has_structured_data: BOOLEAN, "
    "response_time_seconds: DOUBLE, analyzed_at: STRING, analysis_version: STRING, enrichment_status: STRING, "
    "enrichment_error: STRING, from_cache: BOOLEAN>")


# ---------------------------------------------------------------- sources
def load_customers(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Open-schema customer table as text columns with row_no; postal codes keep their zeroes (SC1)."""
    fmt = fmt or {".csv": "csv", ".json": "json"}.get(PurePosixPath(path).suffix.lower(), "parquet")
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"') if fmt == "csv" else spark.read
    df = reader.format(fmt).load(path)
    # a byte-order mark of an exported CSV is not part of the first name
    df = df.toDF(*[c.lstrip("\ufeff") for c in df.columns])
    if V.NAME not in df.columns:
        raise ValueError("Die Datei enthält die erforderliche Spalte KUNDENNAME nicht.")
    if df.limit(1).isEmpty():
        raise ValueError("Die Datei enthält keine Datensätze.")
    cells = {c: (A.normalize_postal_code(F.col(f"`{c}`")) if c.upper() in V.POSTAL_COLUMNS
                 else F.col(f"`{c}`").cast("string")) for c in df.columns if c != ROW_NO}
    df = df.withColumns(cells)
    return df if ROW_NO in df.columns else with_row_no(df)


def scan_companies(companies: DataFrame) -> DataFrame:
    """Company cache in name order (SC2, O2)."""
    return companies.orderBy("company_name", "id")


def decode_enrichments(enrichments: DataFrame) -> DataFrame:
    """Key, website and the nested result; absent fields take their defaults (SC3)."""
    r = F.from_json("result_json", RESULT_SCHEMA)
    decoded = enrichments.select("company_key", "website", r.alias("result"))
    defaults = {"website_score": F.lit(0), "website_score_category": F.lit("Schwach"),
                "short_description": F.lit(V.NO_DESCRIPTION), "enrichment_status": F.lit("Nicht analysiert"),
                "from_cache": F.lit(False)}
    for flag in ("has_https", "ssl_valid", "has_imprint", "has_privacy_policy", "has_contact_page",
                 "has_opening_hours", "has_structured_data"):
        defaults[flag] = F.lit(False)
    for name in ("imprint_url", "privacy_url", "contact_page_url", "contact_form_url", "website_title",
                 "meta_description", "analyzed_at", "analysis_version", "enrichment_error"):
        defaults[name] = F.lit("")
    result = functools.reduce(
        lambda c, item: c.withField(item[0], F.coalesce(F.col(f"result.{item[0]}"), item[1])),
        defaults.items(), F.col("result"))
    return decoded.withColumn("result", F.when(F.col("result").isNotNull(), result))


def scan_pages(pages: DataFrame) -> DataFrame:
    """Pages with their site key and position (SC4)."""
    from kontor.functions import web as U

    elapsed = F.col("elapsed") if "elapsed" in pages.columns else F.lit(0.0)
    return pages.select(F.col("page_id").alias("pos"), F.lower(U.netloc(F.col("url"))).alias("site"), "url", "html",
                        elapsed.alias("elapsed"))


def read_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored change report as (summary, changes, errors) (SC5)."""
    report = spark.read.schema(REPORT_SCHEMA).json(path)
    return (report.drop("changes", "error_details"), report.select(F.inline("changes")),
            report.select(F.inline("error_details")))


def lookup(keys: DataFrame, table: DataFrame, on: Sequence[str], columns: Mapping[str, object]) -> DataFrame:
    """Batch form of keyed point lookups: the wanted columns or their defaults (SC6)."""
    found = table.select(*on, *columns)
    joined = keys.join(found, list(on), "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(d)) for c, d in columns.items()})


def ensure_columns(df: DataFrame, defaults: Mapping[str, object], now: str | None = None) -> DataFrame:
    """Add missing columns with defaults, stamp empty creation and change times; idempotent (SC7)."""
    added = {c: F.lit(d).cast("string") if d is None else F.lit(d) for c, d in defaults.items() if c not in df.columns}
    result = df.withColumns(added) if added else df
    if now is not None:
        for name in ("created_at", "updated_at"):
            stamp = F.coalesce(F.col(name), F.lit(now)) if name in result.columns else F.lit(now)
            result = result.withColumn(name, stamp)
    return result


# ---------------------------------------------------------------- table updates
def next_ids(df: DataFrame, existing: DataFrame, order: Sequence[str]) -> DataFrame:
    """Number new rows after the largest existing id, in a distributed sort order.

    The sorted rows are written once before they are numbered: planned twice, a sort may cut its ranges differently.
    """
    numbered = with_row_no(checkpointed(df.orderBy(*order)), start=1)
    highest = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__top"))
    return numbered.join(F.broadcast(highest), F.lit(True)).withColumn(
        "id", F.col("__top") + F.col(ROW_NO)).drop("__top", ROW_NO)


def latest_per_key(changes: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """Latest change per key; one row per key leaves each map task."""
    window = W.partitionBy(*[F.coalesce(F.col(k), F.lit("")) if dict(changes.dtypes)[k] == "string" else F.col(k) for k in keys]).orderBy(
        *[F.desc(c) for c in order])
    return changes.withColumn("__rank", F.row_number().over(window)).filter("__rank = 1").drop("__rank")


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], overwrite: Sequence[str], now: str,
           order: str | None = None, known_ids: DataFrame | None = None) -> DataFrame:
    """Insert or overwrite by key; id, created_at and unlisted columns survive (SK7).

    Listed columns are overwritten even with blanks. The latest change per key wins by ``order``; without one, and
    among equals, the greatest values win, so that a key never has two changes. New ids follow the greatest of ``known_ids`` where
    ``current`` is a part of the table only.
    """
    latest = latest_per_key(changes, keys, *([order] if order else []), *overwrite)
    new = latest.select(*[F.coalesce(F.col(k), F.lit("")).alias(f"__k_{k}") for k in keys],
                        *[F.col(c).alias(f"__{c}") for c in overwrite], F.lit(True).alias("__new"))
    matches = functools.reduce(operator.and_, [F.coalesce(F.col(k), F.lit("")) == F.col(f"__k_{k}") for k in keys])
    updates = {c: F.col(f"__{c}") for c in overwrite}
    if "updated_at" in current.columns:
        updates["updated_at"] = F.lit(now)
    joined = current.join(new, matches, "left")
    kept = joined.withColumns({c: F.when(F.col("__new"), v).otherwise(F.col(c)) for c, v in updates.items()}).select(*current.columns)
    known = current.select(*[F.coalesce(F.col(k), F.lit("")).alias(f"__k_{k}") for k in keys])
    fresh = new.join(known, [f"__k_{k}" for k in keys], "left_anti")
    fresh = fresh.withColumnsRenamed({f"__k_{k}": k for k in keys}).withColumnsRenamed({f"__{c}": c for c in overwrite}).drop("__new")
    if "id" in current.columns and "id" not in keys:
        fresh = next_ids(fresh, current if known_ids is None else known_ids, list(keys))
    stamps = {c: F.lit(now) for c in ("created_at", "updated_at") if c in current.columns}
    defaults = {c: F.lit(d) for c, d in V.CRM_DEFAULTS.items() if c in current.columns and c not in overwrite}
    fresh = fresh.withColumns({**stamps, **defaults})
    return kept.unionByName(fresh, allowMissingColumns=True)


def save_enrichment(current: DataFrame, results: DataFrame, now: str) -> DataFrame:
    """Upsert analysis results by company key: flat summary columns plus the full JSON (SK6).

    ``results`` has one column ``result`` of the nested result type.
    """
    links = ["facebook", "instagram", "linkedin", "youtube", "tiktok", "x", "pinterest"]
    social = functools.reduce(operator.or_, [F.coalesce(F.col(f"result.social_media.{p}"), F.lit("")) != "" for p in links])
    flat = results.select(
        F.col("result.customer_id").alias("company_id"), F.col("result.company_key").alias("company_key"),
        F.col("result.website").alias("website"), F.to_json("result").alias("result_json"),
        F.to_json("result.imprint_data").alias("imprint_data_json"), F.col("result.website_score").alias("website_score"),
        F.col("result.industry.industry").alias("industry"), F.col("result.has_imprint").alias("has_imprint"),
        F.col("result.has_privacy_policy").alias("has_privacy_policy"),
        F.col("result.has_opening_hours").alias("has_opening_hours"), social.alias("has_social_media"),
        F.col("result.analyzed_at").alias("analyzed_at"), F.col("result.analysis_version").alias("analysis_version"),
        F.col("result.enrichment_status").alias("enrichment_status"),
        F.col("result.enrichment_error").alias("enrichment_error"), F.lit(now).alias("updated_at"))
    latest = latest_per_key(flat, ["company_key"], "analyzed_at")
    untouched = current.join(latest.select("company_key"), "company_key", "left_anti")
    return untouched.select(*[F.col(c) for c in latest.columns if c in untouched.columns]).unionByName(
        latest, allowMissingColumns=True)


def mark_stale(enrichments: DataFrame, keys: DataFrame, now: str) -> DataFrame:
    """Set the status 'Veraltet' in the column and inside the stored JSON (SK12)."""
    wanted = keys.select("company_key").dropDuplicates().withColumn("__hit", F.lit(True))
    joined = enrichments.join(wanted, "company_key", "left")
    parsed = F.from_json("result_json", RESULT_SCHEMA).withField("enrichment_status", F.lit("Veraltet"))
    hit = F.col("__hit").isNotNull()
    updates = {"result_json": F.when(hit, F.to_json(parsed)).otherwise(F.col("result_json")),
               "enrichment_status": F.when(hit, "Veraltet").otherwise(F.col("enrichment_status"))}
    if "updated_at" in enrichments.columns:
        updates["updated_at"] = F.when(hit, F.lit(now)).otherwise(F.col("updated_at"))
    return joined.withColumns(updates).select(*enrichments.columns)


# ---------------------------------------------------------------- sinks
def target_path(path: str, fmt: str) -> str:
    """Check the suffix against the format, add it when absent (SK2)."""
    expected = f".{fmt}"
    suffix = PurePosixPath(path).suffix
    if suffix and suffix.lower() != expected:
        raise ValueError(f"Das gewählte Format benötigt die Dateiendung {expected}.")
    return path if suffix else path + expected


def _write(df: DataFrame, path: str, fmt: str) -> None:
    writer = df.write.mode("errorifexists")
    if fmt == "csv":
        # cells keep their white space
        writer.option("header", True).option("escape", '"').option("emptyValue", "").option(
            "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    else:
        writer.format(fmt).save(path)


def write_customers(df: DataFrame, path: str, fmt: str = "csv") -> str:
    """Write an export, postal codes as text (SK1)."""
    target = target_path(path, fmt)
    postal = {c: A.normalize_postal_code(F.col(f"`{c}`")) for c in df.columns if c.upper() in V.POSTAL_COLUMNS}
    _write(df.withColumns(postal) if postal else df, target, fmt)
    return target


def import_report_rows(report: DataFrame) -> DataFrame:
    """The import report as eleven (metric, value) rows (SK3)."""
    labels = (
        ("Quelldatei", "source_path"), ("Analysezeitpunkt", "analyzed_at"), ("Zeilen vorher", "rows_before"),
        ("Zeilen nachher", "rows_after"), ("Entfernte identische Dubletten", "removed_identical"),
        ("Zusammengeführte Gruppen", "merged_groups"), ("Übersprungene Zeilen", "skipped_rows"),
        ("Ungültige Telefonnummern korrigiert", "corrected_phones"), ("Ungültige E-Mails verworfen", "discarded_emails"),
        ("Normalisierte Websites", "normalized_websites"), ("Offene Konflikte", "open_conflicts"))
    rows = F.array(*[F.struct(F.lit(label).alias("Kennzahl"), T.as_text(F.col(c)).alias("Wert")) for label, c in labels])
    return report.select(F.inline(rows))


def write_cleaned(cleaned: DataFrame, report: DataFrame, source: str, target: str, fmt: str = "parquet") -> None:
    """Cleaned rows and report next to each other; never over the source (SK3)."""
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("Die Originaldatei darf nicht überschrieben werden.")
    write_customers(cleaned, f"{target}/data.{fmt}", fmt)
    _write(import_report_rows(report), f"{target}/report.csv", "csv")


def write_report(changes: DataFrame, summary: DataFrame, path: str, fmt: str = "csv", filter_name: str = "all") -> None:
    """Change report, filtered like the view, with its one-row summary (SK4)."""
    from kontor.operators.research import report_filter

    shown = report_filter(changes, filter_name)
    flat = shown.withColumn("changed_fields", F.array_join("changed_fields", ", ")) if fmt == "csv" else shown
    _write(flat, f"{path}/changes", fmt)
    _write(summary, f"{path}/summary", fmt)


def write_report_json(summary: DataFrame, changes: DataFrame, errors: DataFrame, path: str) -> None:
    """Persist a report as JSON lines (SK5).

    Changes and errors are written as many one-part report records, so a large report is never gathered
    into one document; ``read_report`` inlines all records.
    """
    head = summary.withColumn("part", F.lit("summary"))
    body = changes.select(F.array(F.struct(*changes.columns)).alias("changes"))
    failed = errors.select(F.array(F.struct(*errors.columns)).alias("error_details"))
    head.drop("part").unionByName(body, allowMissingColumns=True).unionByName(
        failed, allowMissingColumns=True).write.mode("errorifexists").json(path)


def write_import_report(report: DataFrame, path: str) -> str:
    """Persist the import report record as JSON, suffix forced (SK13)."""
    target = path if path.lower().endswith(".json") else path + ".json"
    report.write.mode("errorifexists").json(target)
    return target
