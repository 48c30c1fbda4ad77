"""Queries that write to a fresh folder and read back, and streams run to their end into a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.operators import quality, research
from kontor.plans import oracle as O
from kontor.plans.catalog import CATALOG, query
from kontor.plans.site_catalog import _COUNTERS, _CUST, _NEW, _REPORT_SQL, _order_changes
from kontor.session import fresh_path
from kontor.sources import tables
from kontor.streaming import streams

_CELLS = ("KUNDENNAME", "CITY", "PLZ", "TELEFON", "EMAIL", "STATUS")


def _exported(i) -> DataFrame:
    path = tables.write_customers(i.customers.select(*_CELLS), fresh_path(i.spark, "export"), "csv")
    return tables.load_customers(i.spark, path).select("row_no", *[F.coalesce(c, F.lit("")).alias(c) for c in _CELLS])


_EXPORTED = ", ".join(f"""coalesce({O.postal('"PLZ"') if c == "PLZ" else f'"{c}"'}, '') AS "{c}\"""" for c in _CELLS)
query("export_round_trip", "SC1 SK1 SK2", f"SELECT {_EXPORTED} FROM v_customers", "v_customers")(lambda i: _exported(i).drop("row_no"))
query("import_row_numbers", "SC1 W2", "SELECT row_number() OVER () - 1 AS row_no FROM v_customers", "v_customers")(lambda i: _exported(i).select("row_no"))

# ------------------------------------------------------------------ reports
_CHANGE_COLUMNS = [part.split()[0] for part in tables.CHANGE_SCHEMA.split(", ")]


def _changes(i) -> DataFrame:
    return research.build_change(i.paired).select(*_CHANGE_COLUMNS)


def _errors(i) -> DataFrame:
    return i.paired.filter("error_message <> ''").select("company", "city", F.col("error_message").alias("message"))


def _stored_report(i) -> tuple[DataFrame, DataFrame, DataFrame]:
    path = fresh_path(i.spark, "report")
    tables.write_report_json(research.research_report(_changes(i)), _changes(i), _errors(i), path)
    return tables.read_report(i.spark, path)


query("stored_changes", "SC5 SK5", f"SELECT trim(company) AS company, trim(city) AS city, trim(website) AS new_website, old_status, success, {_REPORT_SQL['changed'][1:].partition(') <>')[0]} AS changed FROM v_paired", "v_paired")(
    lambda i: _stored_report(i)[1].select("company", "city", "new_website", "old_status", "success", F.array_join(F.transform("changed_fields", lambda x: F.concat(x, F.lit(","))), "").alias("changed")))
query("stored_errors", "SC5 SK5", "SELECT company, city, error_message AS message FROM v_paired WHERE error_message <> ''", "v_paired")(lambda i: _stored_report(i)[2])
query("stored_summary", "SC5 SK5", f"SELECT {_COUNTERS} FROM {_NEW}", "v_paired")(
    lambda i: _stored_report(i)[0].filter("processed IS NOT NULL").select("processed", "complete", "active", "inactive", "not_found", "contacts_still_incomplete", "websites_found", "websites_corrected", "phones_found", "emails_found"))


def _report_view(i) -> DataFrame:
    path = fresh_path(i.spark, "report-view")
    tables.write_report(_changes(i), research.research_report(_changes(i)), path, "parquet", "status_change")
    return i.spark.read.parquet(f"{path}/changes").select("company", "city", "old_status", "new_status")


query("report_export", "SK4 F14", f"SELECT trim(company) AS company, trim(city) AS city, old_status, new_status FROM {_NEW} WHERE {_REPORT_SQL['status_change']}", "v_paired")(_report_view)


def _import_report(i) -> DataFrame:
    return quality.import_report(i.imported).withColumns({"source_path": F.lit("v_import"), "analyzed_at": F.lit("2024-01-20")})


def _stored_import_report(i) -> DataFrame:
    path = tables.write_import_report(quality.import_report(i.imported), fresh_path(i.spark, "import-report"))
    return i.spark.read.json(path)


def _cleaned(i) -> tuple[DataFrame, DataFrame]:
    target = fresh_path(i.spark, "cleaned")
    tables.write_cleaned(quality.clean_rows(i.imported), _import_report(i), f"{i.sf_dir}/part.parquet", target)
    return i.spark.read.parquet(f"{target}/data.parquet"), i.spark.read.option("header", True).csv(f"{target}/report.csv")


query("stored_import_report", "SK13 A13", CATALOG["import_report"].sql)(_stored_import_report)
query("cleaned_round_trip", "SK3 D11", CATALOG["clean_rows"].sql)(lambda i: _cleaned(i)[0])
_METRICS = {
    "Zeilen vorher": "rows_before", "Zeilen nachher": "rows_after", "Entfernte identische Dubletten": "removed_identical", "Zusammengeführte Gruppen": "merged_groups",
    "Übersprungene Zeilen": "skipped_rows", "Ungültige Telefonnummern korrigiert": "corrected_phones", "Ungültige E-Mails verworfen": "discarded_emails",
    "Normalisierte Websites": "normalized_websites", "Offene Konflikte": "open_conflicts"}
_ROWS = " UNION ALL ".join(f"SELECT '{label}' AS \"Kennzahl\", cast({c} AS varchar) AS \"Wert\" FROM report" for label, c in _METRICS.items())
query("cleaned_report_rows", "SK3", f"WITH report AS ({CATALOG['import_report'].sql}) {_ROWS} UNION ALL SELECT 'Quelldatei', 'v_import' UNION ALL SELECT 'Analysezeitpunkt', '2024-01-20'")(
    lambda i: _cleaned(i)[1])

# ------------------------------------------------------------------ streams


def _drained(i, source: str, transform: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """Run a stream over a whole table with an availableNow trigger; the last complete or all appended results are in a folder."""
    schema = i.spark.read.parquet(source).schema
    target, log = fresh_path(i.spark, "stream"), fresh_path(i.spark, "stream-log")
    result = transform(i.spark.readStream.schema(schema).parquet(f"{source}*"))
    if mode == "append":
        writer = result.writeStream.format("parquet").option("path", target)
    else:
        writer = result.writeStream.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(target))
    writer.option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    return i.spark.read.schema(result.schema).parquet(target)


query("stream_first_of_run", "T-6", "SELECT DISTINCT user_id FROM events")(
    lambda i: _drained(i, f"{i.sf_dir}/events.parquet", lambda s: streams.run_dedup(s.select("user_id", F.col("ts").cast("timestamp").alias("seen")), ["user_id"], "seen", "3650 days").select("user_id"), "append"))


def _stream_dashboard(i) -> DataFrame:
    """The sink keeps the newest counters; at the end of the stream they are those of the whole table."""
    target, log, source = fresh_path(i.spark, "dashboard"), fresh_path(i.spark, "dashboard-log"), f"{i.sf_dir}/orders.parquet"
    stream = i.spark.readStream.schema(i.spark.read.parquet(source).schema).parquet(f"{source}*")
    counts = streams.stream_report_counters(_order_changes(stream))
    run = streams.stream_dashboard(counts, lambda batch, _: batch.write.mode("overwrite").parquet(target)).option("checkpointLocation", log).start()
    run.processAllAvailable()
    run.stop()
    return i.spark.read.parquet(target)


_ORDER_CHANGES = """(SELECT o_orderkey % 7 <> 0 AS success, CASE o_orderstatus WHEN 'F' THEN 'Vollständig' WHEN 'O' THEN 'Aktiv' ELSE 'Nicht aktiv' END AS new_status, '' AS old_status,
  CASE WHEN o_orderkey % 2 = 0 THEN 'x' ELSE '' END AS old_website, CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE '' END AS new_website, CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE '' END AS old_phone,
  CASE WHEN o_orderkey % 2 = 0 THEN 'x' ELSE '' END AS new_phone, CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE '' END AS old_email, CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE '' END AS new_email FROM orders)"""
query("stream_dashboard", "T-4 T-3", f"SELECT {_COUNTERS}, count(*) FILTER (NOT success) AS failed FROM {_ORDER_CHANGES}")(_stream_dashboard)


def _stream_results(i) -> DataFrame:
    """Results arrive in two batches, early numbers first; the second is applied to what the first left behind."""
    source, out, log = (fresh_path(i.spark, name) for name in ("results", "applied", "applied-log"))
    results, customers = i.results, i.customers.drop("ANALYZED_AT", "WEBSITE_SCORE_CATEGORY", "HAS_IMPRINT", "INDUSTRY", "ENRICHMENT_STATUS")
    half = results.agg(F.expr("(min(result_no) + max(result_no)) / 2").cast("long")).first()[0]
    done: list[str] = []

    def snapshot() -> DataFrame:
        return i.spark.read.parquet(done[-1]) if done else customers

    for part in (F.col("result_no") <= half, F.col("result_no") > half):
        results.filter(part).write.mode("append").parquet(source)
        stream = i.spark.readStream.schema(results.schema).parquet(source)
        run = streams.stream_apply_results(stream, snapshot, out, done.append).option("checkpointLocation", log).trigger(availableNow=True).start()
        run.awaitTermination()
    return i.spark.read.parquet(done[-1]).select("row_no", "WEBSITE", "EMAIL", "STATUS", "LAST_CHECK")


query("stream_apply_results", "T-1 J8", _CUST + f""" SELECT c.row_no, CASE WHEN w.row_no IS NULL THEN c."WEBSITE" ELSE {O.clean('w.website')} END AS "WEBSITE", CASE WHEN w.row_no IS NULL THEN c."EMAIL" ELSE {O.clean('w.email')} END AS "EMAIL",
  CASE WHEN w.row_no IS NULL THEN c."STATUS" ELSE w.status END AS "STATUS", CASE WHEN w.row_no IS NULL THEN c."LAST_CHECK" ELSE w.last_check END AS "LAST_CHECK" FROM c LEFT JOIN w USING (row_no)""", "v_customers", "v_results")(_stream_results)
