"""Repeated website analysis: only sites whose stored pages changed are analysed again (F20 inside E22)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kontor import vocab as V
from kontor.functions import text as T
from kontor.functions import web as U
from kontor.operators.common import attach, spread
from kontor.operators.enrich import analyze_sites
from kontor.operators.filters import is_current
from kontor.operators.pages import parse_pages
from kontor.session import written
from kontor.sources.tables import RESULT_SCHEMA

STORED_SCHEMA = f"company_key string, website string, content_digest string, analyzed_at string, analysis_version string, result {RESULT_SCHEMA}"


def site_digests(pages: DataFrame) -> DataFrame:
    """One digest per site over the addresses and the HTML of all its pages, in any order (site, content_digest).

    Sums and exclusive ors of page hashes are of fixed size, so a site with very many pages is reduced on the map side.
    """
    one, two = F.xxhash64("url", "html"), F.xxhash64(F.lit(1), F.md5(F.coalesce("html", F.lit(""))), "url")
    return pages.groupBy("site").agg(F.concat_ws("-", F.count(F.lit(1)), F.hex(F.bit_xor(one)), F.hex(F.bit_xor(two)),
                                                 F.hex(F.sum(F.pmod(one, F.lit(1 << 31))))).alias("content_digest"))


def refresh_analysis(requests: DataFrame, pages: DataFrame, stored: DataFrame | None, now: str, force_refresh: bool = False) -> DataFrame:
    """Analysis of every request: (result_no, company, city, website, customer_id, content_digest, storable, result).

    ``pages`` is the output of ``scan_pages``, not parsed; ``stored`` has the columns of ``STORED_SCHEMA`` and one row per
    company key. A stored result stands (``from_cache``) while it belongs to the same cleaned website, is recent, comes from
    this analysis version, and no page of its site was added, dropped or changed. Only pages of the other sites are parsed.
    Requests without a usable website are answered anew each time and not ``storable``, as they never reach a site.
    """
    spark = requests.sparkSession
    stored = spark.createDataFrame([], STORED_SCHEMA) if stored is None else stored
    checked = U.with_clean_url(requests, F.col("website"), "clean_website").withColumns({
        "company_key": T.company_key(F.col("company"), F.col("city")),
        "storable": (F.col("clean_website") != "") & ~U.is_document(U.path(T.strip(T.as_text(F.col("website")))))})
    checked = checked.withColumn("site", F.lower(U.netloc(F.col("clean_website"))))
    seen = attach(checked, site_digests(pages), ["site"])
    known = stored.select("company_key", F.col("website").alias("__website"), F.col("content_digest").alias("__digest"),
                          F.col("analyzed_at").alias("__at"), F.col("analysis_version").alias("__version"), F.col("result").alias("__result"))
    same = (F.col("storable") & (F.col("__website") == F.col("clean_website")) & F.col("content_digest").eqNullSafe(F.col("__digest"))
            & is_current(F.col("__at"), now) & (F.col("__version") == V.ANALYSIS_VERSION))
    tagged = attach(seen, known, ["company_key"]).withColumn("hit", F.coalesce(same, F.lit(False)) & F.lit(not force_refresh))
    tagged = written(tagged.withColumn("__result", F.when(F.col("hit"), F.col("__result"))), "requests")
    columns = ["result_no", "company", "city"]
    extra = ["content_digest", "storable"]
    reused = tagged.filter("hit").select(*columns, F.col("clean_website").alias("website"), "customer_id", *extra,
                                         F.col("__result").withField("from_cache", F.lit(True)).alias("result"))
    stale = tagged.filter("NOT hit")
    needed = pages.join(stale.select("site").distinct(), "site", "left_semi")
    parsed = written(parse_pages(spread(needed, "pos")), "parsed")
    fresh = analyze_sites(stale.select(*columns, "website", "customer_id"), parsed, now)
    fresh = fresh.join(stale.select("result_no", *extra), "result_no")
    return reused.unionByName(fresh)


def stored_results(refreshed: DataFrame) -> DataFrame:
    """What the next run may reuse: the last result of every company key."""
    rows = refreshed.filter("storable").select(
        "result_no", T.company_key(F.col("company"), F.col("city")).alias("company_key"), "website", "content_digest",
        F.col("result.analyzed_at").alias("analyzed_at"), F.col("result.analysis_version").alias("analysis_version"), "result")
    last = F.row_number().over(W.partitionBy("company_key").orderBy(F.desc("result_no")))
    return rows.withColumn("nth", last).filter("nth = 1").drop("nth", "result_no")
