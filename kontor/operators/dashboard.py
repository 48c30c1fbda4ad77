"""Dashboard metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor import vocab as V
from kontor.functions import text as T
from kontor.operators import crm, quality
from kontor.operators.common import one_row, present, total
from kontor.operators.filters import missing_predicate


def status_counts(df: DataFrame) -> DataFrame:
    """Rows per status and rows missing a contact field (A4)."""
    status = T.normalize_status(present(df, "STATUS"))
    return df.agg(
        F.count(F.lit(1)).alias("total"), total(status == "vollständig").alias("complete"),
        total(status == "aktiv").alias("active"), total(status == "nicht aktiv").alias("inactive"),
        total(status == "nicht gefunden").alias("not_found"),
        *[total(missing_predicate(df, c)).alias(f"missing_{n}") for c, n in (("WEBSITE", "website"), ("TELEFON", "phone"), ("EMAIL", "email"))])


def enrichment_summary(enrichments: DataFrame) -> DataFrame:
    """Averages and counts over successful analyses."""
    return enrichments.filter(F.col("enrichment_status") == "Erfolgreich").agg(
        F.count(F.lit(1)).alias("analyses"), F.coalesce(F.avg("website_score"), F.lit(0.0)).alias("average_website_score"),
        total(F.col("website_score") >= 80).alias("very_good_websites"), total(F.col("website_score") < 40).alias("weak_websites"),
        total(~F.col("has_imprint")).alias("websites_without_imprint"),
        total(~F.col("has_privacy_policy")).alias("websites_without_privacy"),
        total(F.col("has_opening_hours")).alias("websites_with_opening_hours"),
        total(F.col("has_social_media")).alias("websites_with_social_media"))


def enrichment_error_count(enrichments: DataFrame) -> DataFrame:
    """Failed analyses."""
    return enrichments.agg(total(F.col("enrichment_status") == "Fehler").alias("website_analysis_errors"))


def industry_distribution(df: DataFrame, top: int = 8) -> DataFrame:
    """Most frequent industries among analysed rows; the name breaks ties."""
    industry = F.when(T.as_text(F.col("INDUSTRY")) == "", "Unklar").otherwise(F.col("INDUSTRY"))
    counted = df.filter(~T.is_blank(present(df, "ANALYZED_AT")) & F.col("INDUSTRY").isNotNull()).groupBy(
        industry.alias("industry")).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "industry").limit(top)


def website_coverage(df: DataFrame) -> DataFrame:
    """Rows with a website, analysed and not."""
    site, analyzed = ~T.is_blank(present(df, "WEBSITE")), ~T.is_blank(present(df, "ANALYZED_AT"))
    return df.agg(total(site & analyzed).alias("websites_analyzed"), total(site & ~analyzed).alias("websites_not_analyzed"))


def dashboard(customers: DataFrame, companies: DataFrame, activities: DataFrame, enrichments: DataFrame,
              visible: DataFrame, changes: DataFrame, report: DataFrame, now: str) -> DataFrame:
    """All dashboard metrics in one row (A15); only one-row results and a top-k meet here."""
    from kontor.operators.research import recent_changes

    q = quality.dashboard_quality(customers).withColumnsRenamed({"duplicates": "detected_duplicates"})
    industries = industry_distribution(customers).agg(
        F.map_from_entries(F.collect_list(F.struct("industry", "n"))).alias("industry_distribution"))
    recent = recent_changes(changes).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("result_no", "company", "city", "new_status"))),
                    lambda c: F.concat_ws("|", c["company"], c["city"], c["new_status"])).alias("recent_changes"))
    last = report.select(F.col("processed").alias("last_research_processed"), F.col("errors").alias("last_research_errors"),
                         F.col("cancelled").alias("last_research_cancelled"), F.col("duration_seconds").alias("last_research_duration"))
    return one_row(
        status_counts(customers), q, visible.agg(F.count(F.lit(1)).alias("visible_rows")),
        crm.crm_counts(companies, activities, now), enrichment_summary(enrichments).drop("analyses"),
        enrichment_error_count(enrichments), website_coverage(customers), industries, recent, last)
