"""Crawled pages: parsing, page kinds, links, contacts."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import StringType

from kontor import vocab as V
from kontor.functions import address as A
from kontor.functions import contacts as C
from kontor.functions import text as T
from kontor.functions import web as U
from kontor.session import checkpointed

_PARSED = (
    "title string, meta_description string, headings array<string>, "
    "links array<struct<url:string, href:string, text:string, hidden:boolean>>, "
    "jsonld array<struct<types:array<string>, telephone:string, street:string, zipcode:string, city:string, "
    "country:string, opening_hours:array<string>, specs:array<struct<days:array<string>, opens:string, closes:string>>>>, "
    "microdata_hours array<string>, visible_text string, paragraphs array<string>, has_form boolean, "
    "phones array<struct<value:string, context:string>>, pairs array<struct<label:string, value:string>>, "
    "lines array<string>")


def parse_pages(pages: DataFrame) -> DataFrame:
    """Typed content of every page (E1); the HTML itself is dropped.

    ``pages`` needs url and html; other columns pass through. Parsing is per row, so it follows the
    partitioning of the input and needs no shuffle.
    """
    kept = [f for f in pages.schema.fields if f.name != "html"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [_PARSED])
    names = [f.name for f in kept]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from kontor.functions.html import read_page

        for batch in batches:
            parsed = pd.DataFrame([read_page(u or "", h or "") for u, h in zip(batch["url"], batch["html"])],
                                  index=batch.index)
            yield pd.concat([batch[names], parsed], axis=1)

    return pages.mapInPandas(parse, schema).withColumn("kind", classify_page(F.col("url"), F.col("title")))


def _first_kind(text: Column) -> Column:
    kinds = list(V.PAGE_KEYWORDS.items())
    has = lambda words: text.rlike("|".join(words))
    return functools.reduce(lambda chain, item: chain.when(has(item[1]), item[0]), kinds[1:], F.when(has(kinds[0][1]), kinds[0][0]))


def classify_page(url: Column, title: Column) -> Column:
    """First page kind whose keyword occurs in url or title, else home."""
    return _first_kind(T.casefold(F.concat_ws(" ", url, title))).otherwise("home")


def internal_links(parsed: DataFrame) -> DataFrame:
    """Cleaned links to the same host, without log-in and account pages."""
    rows = parsed.select("site", "pos", "url", F.posexplode("links").alias("link_pos", "link"))
    rows = rows.select("site", "pos", "url", "link_pos", F.col("link.href").alias("href"),
                       F.col("link.text").alias("text"), F.col("link.url").alias("target"))
    same = F.lower(U.netloc(F.col("target"))) == F.lower(U.netloc(F.col("url")))
    rows = rows.filter((F.col("href") != "") & ~F.col("href").rlike(r"^(?:mailto:|tel:|javascript:|#)")
                       & U.usable_url(F.col("target")) & same)
    rows = U.with_clean_url(rows, F.col("target"), "link").drop("target")
    return rows.filter(~F.lower("link").rlike("|".join(V.BLOCKED_LINK_TOKENS)))


def frontier(parsed: DataFrame, max_pages: int = V.ANALYSIS_MAX_PAGES) -> DataFrame:
    """Pages to analyse per start page: itself and its best internal links.

    Links without a stored page use up no place. The others rank by page kind, then by position; per start page at
    most ``max_pages`` rows leave a task.
    """
    links = internal_links(parsed)
    links = links.withColumn("words", F.concat_ws(" ", T.casefold(F.col("text")), T.casefold(F.col("link"))))
    kinds = F.array(*[F.lit(k) for k in V.PAGE_KEYWORDS])
    ranked = links.withColumn("priority", F.array_position(kinds, _first_kind(F.col("words")).otherwise("")) - 1)
    wanted = (F.col("priority") >= 0) & (F.col("link") != F.col("url"))
    best = ranked.groupBy("site", "pos", "url", "link").agg(
        F.min(F.when(wanted, F.struct("priority", "link_pos"))).alias("place")).filter("place IS NOT NULL")
    best = best.join(parsed.select(F.col("url").alias("link")).distinct(), "link", "left_semi")
    window = W.partitionBy("site", "pos", "url").orderBy("place")
    chosen = best.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= max_pages - 1)
    home = parsed.select("site", "pos", "url", F.col("url").alias("page_url"), F.lit(0).alias("rank"))
    return home.unionByName(chosen.select("site", "pos", "url", F.col("link").alias("page_url"), "rank"))


def first_of_kind(parsed: DataFrame) -> DataFrame:
    """First page of every kind and first page with a form, per site."""
    return parsed.groupBy("site").agg(
        *[F.min_by("url", F.when(F.col("kind") == k, F.col("pos"))).alias(f"{k}_url") for k in V.PAGE_KEYWORDS],
        F.min_by("url", F.when(F.col("has_form"), F.col("pos"))).alias("form_url"))


def _contact_hits(parsed: DataFrame) -> DataFrame:
    """Links whose text or address names a contact or legal page."""
    rows = parsed.select("site", "pos", "url", F.posexplode("links").alias("link_pos", "link"))
    pattern = "(?:" + "|".join(V.CONTACT_PAGE_KEYWORDS) + ")"
    hit = F.lower("link.text").rlike(pattern) | F.lower(F.trim("link.href")).rlike(pattern)
    return rows.filter(hit).select("site", "pos", "url", "link_pos", F.trim("link.href").alias("href"), F.col("link.url").alias("address"))


def contact_links(parsed: DataFrame) -> DataFrame:
    """Distinct links that look like contact or legal pages, in page order, under their cleaned URL."""
    named = U.with_clean_url(_contact_hits(parsed), F.col("address"), "target").filter("target <> ''")
    return named.groupBy("site", "pos", "url", "target").agg(F.min("link_pos").alias("link_pos"))


@pandas_udf(StringType())
def _joined(base: pd.Series, href: pd.Series) -> pd.Series:
    """Links resolved against the start page of their walk."""
    from kontor.functions.html import joined

    return pd.Series([joined(b, h) for b, h in zip(base, href)], dtype="object")


def contact_frontier(parsed: DataFrame, max_pages: int = V.CONTACT_MAX_PAGES) -> DataFrame:
    """The pages a contact search visits from every start page, in order: (site, pos, url, page_url, rank).

    A first-in-first-out queue per start page, all queues advanced together by one level of links. A page that is not
    stored is visited in vain but takes its place; links count in page order and are resolved against the start page.
    A queue holds at most ``max_pages`` entries, so a level adds a bounded number of rows per start page; what leaves
    the loop each round is one flag.
    """
    hits = _contact_hits(parsed)
    links = checkpointed(hits.groupBy(F.col("url").alias("page_url"), "href").agg(F.min(F.struct("pos", "link_pos")).alias("link_place")))
    key = ["site", "pos", "url"]
    queues = checkpointed(parsed.select(*key, F.array("url").alias("queue"), F.lit(0).alias("done")))
    for _ in range(max_pages - 1):
        fresh = queues.select(*key, "queue", F.posexplode("queue").alias("at", "page_url"), "done").filter("at >= done")
        found = fresh.join(links, "page_url").withColumn("resolved", _joined("url", "href"))
        found = U.with_clean_url(found, F.col("resolved"), "target").filter("target <> '' AND NOT array_contains(queue, target)")
        first = found.groupBy(*key, "target").agg(F.min(F.struct("at", "link_place")).alias("place"), F.first(F.size("queue")).alias("held"))
        ranked = first.withColumn("nth", F.row_number().over(W.partitionBy(*key).orderBy("place")))
        added = ranked.filter(F.col("nth") + F.col("held") <= max_pages).groupBy(*key).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("nth", "target"))), lambda x: x["target"]).alias("added"))
        queues = checkpointed(queues.join(added, key, "left").select(
            *key, F.concat("queue", F.coalesce("added", F.array().cast("array<string>"))).alias("queue"), F.size("queue").alias("done")))
        if queues.filter(F.size("queue") > F.col("done")).isEmpty():
            break
    return queues.select(*key, F.posexplode("queue").alias("rank", "page_url")).select(*key, "page_url", "rank")


_EMAIL_IN_TEXT = r"([A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"
# Up to five capitalised words and a house number, then digits of a postal code and up to four capitalised words.
_CAPITALS = rf"{A.CAPITAL_WORD}(?:\s+{A.CAPITAL_WORD})"
_ADDRESS = rf"(?U)({_CAPITALS}{{0,4}}\s+{A.HOUSE})[\s,]+(\d{{4,6}})\s+({_CAPITALS}{{0,3}})"


def _page_source(url: Column) -> Column:
    low = F.lower(url)
    return (F.when(F.contains(low, F.lit("kontakt")) | F.contains(low, F.lit("contact")), "contact")
            .when(F.contains(low, F.lit("impress")), "imprint").otherwise("text"))


def with_candidates(parsed: DataFrame) -> DataFrame:
    """Pages with their phone, e-mail and address candidates, in the order they are found."""
    source = _page_source(F.col("url"))
    visible_links = F.filter("links", lambda x: ~x["hidden"])

    def linked(prefix):
        chosen = F.filter(visible_links, lambda x: F.startswith(F.lower(x["href"]), F.lit(prefix)))
        return chosen, lambda x: F.substring_index(F.substring(x["href"], len(prefix) + 1, 1 << 30), "?", 1)

    tel, tel_value = linked("tel:")
    mail, mail_value = linked("mailto:")
    item = lambda value, src, context, required: F.struct(
        value.alias("value"), src.alias("source"), context.alias("context"), F.lit(required).alias("require_context"))
    phones = F.concat(
        F.transform("phones", lambda p: item(p["value"], source, p["context"], True)),
        F.transform(tel, lambda x: item(tel_value(x), F.lit("tel"), x["text"], False)),
        F.transform(F.filter("jsonld", lambda n: n["telephone"] != ""),
                    lambda n: item(n["telephone"], F.lit("jsonld"), F.lit("Telefon"), False)))
    emails = F.concat(F.regexp_extract_all("visible_text", F.lit(_EMAIL_IN_TEXT), F.lit(1)), F.transform(mail, mail_value))
    found = F.arrays_zip(*[F.regexp_extract_all("visible_text", F.lit(_ADDRESS), F.lit(i)).alias(n)
                           for i, n in ((1, "street"), (2, "zipcode"), (3, "city"))])
    place = lambda a, country, src: F.struct(
        a["street"].alias("street"), A.normalize_postal_code(a["zipcode"]).alias("zipcode"), a["city"].alias("city"),
        country.alias("country"), src.alias("source"))
    addresses = F.concat(
        F.transform(found, lambda a: place(a, F.lit(""), source)),
        F.transform(F.filter("jsonld", lambda n: n["street"] != ""), lambda n: place(n, n["country"], F.lit("jsonld"))))
    return parsed.withColumns({"phones": phones, "emails": emails, "addresses": addresses})


def contact_candidates(parsed: DataFrame) -> DataFrame:
    """The candidates of every page without its content."""
    return with_candidates(parsed).select("site", "pos", "url", "phones", "emails", "addresses")


def choose_phone(candidates: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Best valid phone per key by source, number type and order.

    ``candidates`` has the keys, value, source, context and require_context. The choice is a fixed-size
    aggregate, so a site with very many numbers needs no sort.
    """
    rows = C.with_phone(candidates, F.col("value"), "phone", source=F.col("source"), context=F.col("context"),
                        require_context=F.col("require_context"))
    rank = lambda column, table, default: functools.reduce(
        lambda chain, kv: chain.when(column == kv[0], kv[1]), list(table.items())[1:],
        F.when(column == next(iter(table)), next(iter(table.values())))).otherwise(default)
    place = F.struct(rank(F.col("source"), V.PHONE_SOURCE_RANK, 5), rank(F.col("phone_type"), V.PHONE_TYPE_RANK, 2), order)
    # The validity test sits in the aggregate: as a filter it would be pushed below the staged validation
    # and repeat all of it.
    return rows.groupBy(*keys).agg(F.min_by("phone", F.when(F.col("phone") != "", place)).alias("phone"))


def choose_email(candidates: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Preferred valid e-mail per key by mailbox name and order."""
    rows = candidates.withColumn("email", C.email(F.col("value"))).filter("email <> ''")
    return rows.groupBy(*keys).agg(F.min_by("email", F.struct(C.mailbox_rank(F.col("email")), order)).alias("email"))


def site_contacts(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Best phone, best e-mail and all addresses per key.

    ``candidates`` is the output of ``contact_candidates`` restricted to the pages of each key.
    """
    order = F.struct("pos", "at")
    phones = candidates.select(*keys, "pos", F.posexplode("phones").alias("at", "c")).select(*keys, "pos", "at", "c.*")
    emails = candidates.select(*keys, "pos", F.posexplode("emails").alias("at", "value"))
    addresses = candidates.select(*keys, "pos", F.posexplode("addresses").alias("at", "address")).groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.col("address"))).alias("addresses"))
    base = candidates.select(*keys).dropDuplicates()
    joined = base.join(choose_phone(phones, keys, order), keys, "left").join(
        choose_email(emails, keys, order), keys, "left").join(addresses, keys, "left")
    empty = F.array().cast("array<struct<street:string,zipcode:string,city:string,country:string,source:string>>")
    return joined.withColumns({"phone": F.coalesce("phone", F.lit("")), "email": F.coalesce("email", F.lit("")),
                               "addresses": F.coalesce("addresses", empty)})
