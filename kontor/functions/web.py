"""URL cleaning (X12, X13, F25) and URL parts.

The functions are staged projections on a DataFrame: each intermediate value is a column of its own, so
it is evaluated once per row instead of once per mention.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontor import vocab as V
from kontor.functions import text as T

_DOCUMENT = r"(?:" + "|".join(s.replace(".", r"\.") for s in V.DOCUMENT_SUFFIXES) + r")$"
_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SPLIT, 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, _SPLIT, 2)


def path(url: Column) -> Column:
    """Path without the parameters of its last segment."""
    return F.regexp_replace(F.regexp_extract(url, _SPLIT, 3), r";[^/]*$", "")


def query(url: Column) -> Column:
    return F.regexp_extract(url, _SPLIT, 4)


def bare_host(host: Column) -> Column:
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def is_document(url_path: Column) -> Column:
    return F.lower(url_path).rlike(_DOCUMENT)


def _recode(value: Column) -> Column:
    decoded = F.coalesce(F.try_url_decode(value), value)
    coded = F.url_encode(decoded)
    return F.replace(F.replace(coded, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def clean_query(value: Column, tracking=V.TRACKING_PARAMETERS) -> Column:
    """Drop tracking and blank parameters, re-encode the others."""
    def name_of(part):
        return F.lower(F.coalesce(F.try_url_decode(F.substring_index(part, "=", 1)), F.substring_index(part, "=", 1)))

    def keep(part):
        return part.rlike(r"^[^=]*=.") & ~F.startswith(name_of(part), F.lit("utm_")) & ~name_of(part).isin(*tracking)

    kept = F.filter(F.split(value, "&"), keep)
    recoded = F.transform(kept, lambda p: F.concat(
        _recode(F.substring_index(p, "=", 1)), F.lit("="), _recode(F.regexp_replace(p, r"^[^=]*=", ""))))
    return F.when(F.coalesce(value, F.lit("")) == "", "").otherwise(F.array_join(recoded, "&"))


def _assemble(scheme_: Column, host: Column, path_: Column, query_: Column) -> Column:
    tail = F.when(query_ == "", "").otherwise(F.concat(F.lit("?"), query_))
    return F.concat(scheme_, F.lit("://"), host, path_, tail)


def usable_url(raw: Column) -> Column:
    """Will ``with_clean_url`` give a URL? Decided on the raw text, so it can be filtered on cheaply."""
    value = T.strip(T.as_text(raw))
    hosts = "|".join(h.replace(".", r"\.") for h in V.BLACKLISTED_HOSTS)
    return value.rlike(r"(?i)^https?://[^/?#]") & ~value.rlike(rf"(?i)^https?://(?:www\.)?(?:{hosts})(?:[/?#].*)?$")


def with_clean_url(df: DataFrame, value: Column, out: str) -> DataFrame:
    """Add ``out``: the web URL without document paths and tracking, '' when unusable."""
    t = f"__{out}"
    staged = df.withColumn(f"{t}_raw", T.strip(T.as_text(value)))
    raw = F.col(f"{t}_raw")
    staged = staged.withColumns({
        f"{t}_scheme": scheme(raw), f"{t}_host": netloc(raw), f"{t}_path": path(raw), f"{t}_query": query(raw)})
    host, url_path = F.col(f"{t}_host"), F.col(f"{t}_path")
    usable = F.col(f"{t}_scheme").isin("http", "https") & (host != "") & ~bare_host(host).isin(*V.BLACKLISTED_HOSTS)
    safe_path = F.when((url_path == "") | is_document(url_path), "/").otherwise(url_path)
    cleaned = _assemble(F.col(f"{t}_scheme"), host, safe_path, clean_query(F.col(f"{t}_query")))
    return staged.withColumn(out, F.when(usable, cleaned).otherwise("")).drop(
        *[f"{t}_{p}" for p in ("raw", "scheme", "host", "path", "query")])


def with_website(df: DataFrame, value: Column, out: str) -> DataFrame:
    """Add ``out``: canonical website of a customer cell, '' for documents and non-URLs."""
    t = f"__{out}"
    staged = df.withColumn(f"{t}_text", T.cell_text(value))
    cell = F.col(f"{t}_text")
    staged = staged.withColumn(
        f"{t}_url", F.when(cell.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), cell).otherwise(F.concat(F.lit("https://"), cell)))
    url = F.col(f"{t}_url")
    staged = staged.withColumns({
        f"{t}_scheme": scheme(url), f"{t}_host": F.lower(netloc(url)), f"{t}_path": path(url), f"{t}_query": query(url)})
    host, url_path = F.col(f"{t}_host"), F.col(f"{t}_path")
    usable = (
        (cell != "") & F.col(f"{t}_scheme").isin("http", "https") & (host != "")
        & ~is_document(url_path) & ~bare_host(host).isin(*V.BLACKLISTED_HOSTS))
    cleaned = _assemble(F.col(f"{t}_scheme"), host, F.when(url_path == "", "/").otherwise(url_path),
                        clean_query(F.col(f"{t}_query")))
    return staged.withColumn(out, F.when(usable, F.rtrim(cleaned, F.lit("/"))).otherwise("")).drop(
        *[f"{t}_{p}" for p in ("text", "url", "scheme", "host", "path", "query")])


def with_valid_website(df: DataFrame, value: Column, out: str) -> DataFrame:
    """Like ``with_clean_url`` but document links give '' instead of the host root."""
    staged = with_clean_url(df, value, out)
    document = is_document(path(T.strip(T.as_text(value))))
    return staged.withColumn(out, F.when(document, "").otherwise(F.col(out)))
