"""Applying research results, change reports, candidate ranking."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontor import vocab as V
from kontor.functions import address as A
from kontor.functions import contacts as C
from kontor.functions import text as T
from kontor.functions import web as U
from kontor.operators.common import ROW_NO, attach, first_column, keep_where, nth_of_key, one_per_key, one_row, present, spread, total
from kontor.operators.filters import is_current
from kontor.session import checkpointed

RESULT_COLUMNS = {"WEBSITE": "website", "TELEFON": "phone", "EMAIL": "email", "STATUS": "status",
                  "SOURCE": "source", "LAST_CHECK": "last_check"}


def result_key(customer_id: Column, company: Column, city: Column) -> Column:
    """('id', id) when there is an id, else ('company', company key)."""
    return F.when(customer_id.isNotNull(), F.struct(F.lit("id").alias("kind"), customer_id.cast("string").alias("key"))).otherwise(
        F.struct(F.lit("company").alias("kind"), T.company_key(company, city).alias("key")))


def _keyed_customers(customers: DataFrame, street: bool) -> DataFrame:
    keys = {f"__id{i}": F.col(f"`{c}`").cast("string") for i, c in enumerate(c for c in V.ID_COLUMNS if c in customers.columns)}
    keys["__key"] = T.company_key(present(customers, V.NAME), present(customers, V.CITY))
    if street:
        column = first_column(customers, V.STREET_COLUMNS)
        keys["__street"] = F.concat_ws("|", A.street_name(column), A.house_number(column))
    return customers.withColumns(keys)


def _tiers(keyed: DataFrame, street: bool) -> list[list[str]]:
    tiers = [[c] for c in keyed.columns if c.startswith("__id")]
    if street:
        tiers.append(["__key", "__street"])
    return tiers + [["__key"]]


def _keyed_results(results: DataFrame, tiers: Sequence[Sequence[str]]) -> DataFrame:
    keys = {"__key": T.company_key(T.clean_missing(F.col("company")), T.clean_missing(F.col("city")))}
    for tier in tiers:
        if tier[0].startswith("__id"):
            keys[tier[0]] = F.col("customer_id").cast("string")
        if "__street" in tier:
            name = A.street_name(F.col("street"))
            keys["__street"] = F.when(A.usable(name), F.concat_ws("|", name, A.house_number(F.col("street"))))
    return results.withColumns(keys)


def _with_tier(results: DataFrame, keyed: DataFrame, tiers: Sequence[Sequence[str]], extra: Sequence[Column] = ()) -> DataFrame:
    """Tag each result with the first tier under which any customer row matches.

    The customer side is reduced to one row per key first, so frequent keys meet the results only once.
    """
    tagged = results
    for i, tier in enumerate(tiers):
        known = keyed.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in tier)).groupBy(*tier).agg(
            F.min(ROW_NO).alias(f"__first{i}"), *[e.alias(f"__extra{i}_{j}") for j, e in enumerate(extra)])
        tagged = attach(tagged, known, tier)
    tier = F.coalesce(*[F.when(F.col(f"__first{i}").isNotNull(), i) for i in range(len(tiers))])
    return tagged.withColumn("__tier", tier)


def _addresses(rows: DataFrame, tiers: Sequence[Sequence[str]], carried: Sequence[str]) -> DataFrame:
    """One row per address of a row: the carried columns, the tier and the tier's key as one text."""
    entry = lambda i, tier: F.when(
        functools.reduce(operator.and_, [F.col(c).isNotNull() for c in tier]),
        F.struct(F.lit(i).alias("__tier"), F.concat_ws("\x1f", F.lit(str(i)), *tier).alias("__address")))
    found = F.explode(F.array_compact(F.array(*[entry(i, tier) for i, tier in enumerate(tiers)])))
    return rows.select(*carried, found.alias("__at")).select(*carried, "__at.*")


def match_results(customers: DataFrame, results: DataFrame, values: Column, *, use_street: bool) -> DataFrame:
    """Customers with ``__hit``: (result_no, values) of the latest result that addresses the row.

    A result addresses all rows with its id; if there is none, all rows with its key and street; if there
    is none, all rows with its key. All tiers are addresses of one slim table: results keep the least tier
    that a customer has, each address its latest result, each row its latest address; the wide customer rows
    move once, at the end.
    """
    keyed = _keyed_customers(spread(customers), use_street)
    tiers = _tiers(keyed, use_street)
    mine = checkpointed(_addresses(keyed, tiers, [ROW_NO]).drop("__tier"))
    owner = ["result_no", "__key", "customer_id", "street"] if "street" in results.columns else ["result_no", "__key", "customer_id"]
    theirs = _addresses(_keyed_results(results, tiers).withColumn("__picked", F.struct("result_no", values.alias("values"))), tiers, [*owner, "__picked"])
    known = attach(theirs, mine.select("__address").distinct(), ["__address"], "inner")
    chosen = known.groupBy(*owner).agg(F.min_by(F.struct("__address", "__picked"), "__tier").alias("chosen")).select("chosen.*")
    winners = chosen.groupBy("__address").agg(F.max_by("__picked", "__picked.result_no").alias("__hit"))
    hits = attach(mine, winners, ["__address"], "inner").groupBy(ROW_NO).agg(F.max_by("__hit", "__hit.result_no").alias("__hit"))
    return customers.join(hits, ROW_NO, "left")


def apply_results(customers: DataFrame, results: DataFrame, now: str | None = None) -> DataFrame:
    """Overwrite the six contact columns of all rows a result addresses.

    ``results`` has result_no (arrival order), company, city, customer_id, street and the six values.
    When a result changes the website of any of its rows, the analysis columns of its rows are blanked.
    """
    values = F.struct(*[T.clean_missing(F.col(c)).alias(c) for c in RESULT_COLUMNS.values()])
    matched = match_results(customers, results, values, use_street=True)
    hit = F.col("__hit").isNotNull()
    analysis = [c for c in customers.columns if c in V.ENRICHMENT_COLUMNS]
    updates = {label: F.when(hit, F.col(f"__hit.values.{c}")).otherwise(present(customers, label, F.lit(None).cast("string")))
               for label, c in RESULT_COLUMNS.items()}
    if analysis:
        matched = _website_changed(matched)
        for c in analysis:
            updates[c] = F.when(F.col("__changed"), F.lit("")).otherwise(F.col(c).cast("string"))
    return matched.withColumns(updates).select(*customers.columns, *[c for c in RESULT_COLUMNS if c not in customers.columns])


def _website_changed(matched: DataFrame) -> DataFrame:
    rows = U.with_clean_url(matched, F.col("WEBSITE"), "__old_site")
    rows = U.with_clean_url(rows, F.col("__hit.values.website"), "__new_site").withColumn("__no", F.col("__hit.result_no"))
    changed = rows.filter("__no IS NOT NULL").groupBy("__no").agg(
        F.max(F.col("__old_site") != F.col("__new_site")).alias("__changed"))
    return attach(rows, changed, ["__no"]).withColumn("__changed", F.coalesce("__changed", F.lit(False)))


def stale_keys(customers: DataFrame, results: DataFrame) -> DataFrame:
    """Company keys whose website a result changes; their stored analysis is outdated (feeds SK12)."""
    values = F.struct(T.clean_missing(F.col("website")).alias("website"), F.col("__key").alias("key"))
    matched = match_results(customers, results, values, use_street=True).filter("__hit IS NOT NULL")
    rows = U.with_clean_url(matched, F.col("WEBSITE"), "__old_site")
    rows = U.with_clean_url(rows, F.col("__hit.values.website"), "__new_site")
    return keep_where(rows, F.col("__old_site") != F.col("__new_site")).select(F.col("__hit.values.key").alias("company_key")).dropDuplicates()


def apply_enrichment(customers: DataFrame, results: DataFrame) -> DataFrame:
    """Write the flat analysis columns into all rows a result addresses, by id, else by key.

    ``results`` has result_no, company, city, customer_id and the flat columns.
    """
    keys = {"result_no", "company", "city", "customer_id"}
    flat = [c for c in results.columns if c not in keys]
    matched = match_results(customers, results, F.struct(*[F.col(c) for c in flat]), use_street=False)
    updates = {c: F.when(F.col("__hit").isNotNull(), F.col("__hit.values")[c]).otherwise(
        present(customers, c, F.lit(None))) for c in flat}
    return matched.withColumns(updates).select(*customers.columns, *[c for c in flat if c not in customers.columns])


def enrichment_offer(results: DataFrame, customers: DataFrame, now: str, force_refresh: bool = False) -> DataFrame:
    """Successful results with a usable website and the first customer row they address.

    ``skipped`` marks rows whose analysis is current; the others are offered.
    """
    keyed = _keyed_customers(customers, False)
    tiers = _tiers(keyed, False)
    fine = F.coalesce(F.col("success"), F.lit(True)) & T.is_blank(F.col("error_message"))
    usable = U.with_valid_website(results.filter(fine), F.col("website"), "offer_website").filter("offer_website <> ''")
    analyzed = F.min_by(T.as_text(present(customers, "ANALYZED_AT")), ROW_NO)
    tagged = _with_tier(_keyed_results(usable, tiers), keyed, tiers, [analyzed]).filter("__tier IS NOT NULL")
    choose = lambda stem: F.coalesce(*[F.when(F.col("__tier") == i, F.col(f"{stem.format(i)}")) for i in range(len(tiers))])
    skipped = F.lit(False) if force_refresh else is_current(F.col("analyzed_at"), now)
    return tagged.select("result_no", choose("__first{}").alias(ROW_NO), F.col("offer_website").alias("WEBSITE"),
                         choose("__extra{}_0").alias("analyzed_at")).withColumn("skipped", skipped)


def key_intersection(results: DataFrame, keys: DataFrame) -> DataFrame:
    """Results whose key is in a key set."""
    keyed = results.withColumn("result_key", result_key(F.col("customer_id"), F.col("company"), F.col("city")))
    return keyed.join(keys.select("result_key").dropDuplicates(), "result_key", "left_semi")


def pair_before_after(before: DataFrame, results: DataFrame) -> DataFrame:
    """The n-th result of a key pairs with the n-th original row of that key.

    Returns the results with the originals' contact columns as old_*; blank where rows run out.
    """
    def trimmed(c):
        return T.strip(T.as_text(F.col(c)))

    old = before.select(
        F.col(ROW_NO), trimmed(V.NAME).alias("__n"), trimmed(V.CITY).alias("__c"),
        *[trimmed(c).alias(f"old_{n}") for c, n in (("WEBSITE", "website"), ("TELEFON", "phone"), ("EMAIL", "email"), ("STATUS", "status"))])
    new = results.withColumns({"__n": trimmed("company"), "__c": trimmed("city")})
    left = nth_of_key(new, ["__n", "__c"], "result_no")
    right = nth_of_key(old, ["__n", "__c"], ROW_NO).drop(ROW_NO)
    joined = left.join(right, ["__n", "__c", "nth"], "left")
    return joined.fillna("", subset=["old_website", "old_phone", "old_email", "old_status"]).drop("__n", "__c", "nth")


def build_change(paired: DataFrame) -> DataFrame:
    """Old and new values with the list of changed fields."""
    fields = (("website", "website"), ("phone", "telefon"), ("email", "email"), ("status", "status"))
    rows = paired.withColumns({f"new_{f}": T.strip(T.as_text(F.col(f))) for f, _ in fields})
    changed = F.array_compact(F.array(*[
        F.when(F.col(f"old_{f}") != F.col(f"new_{f}"), F.lit(label)) for f, label in fields]))
    success = F.coalesce(F.col("success"), F.lit(True)) if "success" in paired.columns else F.lit(True)
    message = T.as_text(F.col("error_message")) if "error_message" in paired.columns else F.lit("")
    return rows.select(
        "result_no", T.strip(T.as_text(F.col("company"))).alias("company"), T.strip(T.as_text(F.col("city"))).alias("city"),
        *[f"{age}_{f}" for f, _ in fields for age in ("old", "new")], changed.alias("changed_fields"),
        success.alias("success"), message.alias("error_message"))


_WEBSITE_FOUND = "old_website = '' AND new_website <> ''"
_WEBSITE_CORRECTED = "old_website <> '' AND new_website <> '' AND old_website <> new_website"
REPORT_FILTERS = {
    "changed": "size(changed_fields) > 0",
    "errors": "NOT success OR error_message <> ''",
    "incomplete": "new_status IN ('Aktiv', 'Nicht aktiv')",
    "status_change": "old_status <> new_status",
    "new_phone": "old_phone = '' AND new_phone <> ''",
    "new_email": "old_email = '' AND new_email <> ''",
    "website": f"({_WEBSITE_FOUND}) OR ({_WEBSITE_CORRECTED})",
}


def report_filter(changes: DataFrame, name: str) -> DataFrame:
    """One named view of a change report; unknown names show everything."""
    return changes.filter(REPORT_FILTERS[name]) if name in REPORT_FILTERS else changes


def report_filter_and(changes: DataFrame, *, changed=False, errors=False, incomplete=False) -> DataFrame:
    """The dialog's criteria, all of them at once; errors means failed only."""
    for on, condition in ((changed, REPORT_FILTERS["changed"]), (errors, "NOT success"),
                          (incomplete, REPORT_FILTERS["incomplete"])):
        changes = changes.filter(condition) if on else changes
    return changes


def report_counters() -> list[Column]:
    """Counter aggregates of a change report, usable in batch and on a stream (A10, T-3)."""
    ok = F.col("success")
    return [
        F.count(F.lit(1)).alias("processed"), total(~ok).alias("failed"),
        total(ok & (F.col("new_status") == V.STATUS_COMPLETE)).alias("complete"),
        total(ok & (F.col("new_status") == V.STATUS_ACTIVE)).alias("active"),
        total(ok & (F.col("new_status") == V.STATUS_INACTIVE)).alias("inactive"),
        total(ok & (F.col("new_status") == V.STATUS_NOT_FOUND)).alias("not_found"),
        total(F.expr(_WEBSITE_FOUND)).alias("websites_found"),
        total(F.expr(_WEBSITE_CORRECTED)).alias("websites_corrected"),
        total(F.expr(REPORT_FILTERS["new_phone"])).alias("phones_found"),
        total(F.expr(REPORT_FILTERS["new_email"])).alias("emails_found"),
        total(ok & (F.col("new_status") == V.STATUS_INACTIVE)).alias("contacts_still_incomplete"),
    ]


def research_report(changes: DataFrame, errors: DataFrame | None = None, total_rows: int | None = None, *,
                    started_at: str = "", finished_at: str = "", cancelled: bool = False) -> DataFrame:
    """Counters of a research run in one row."""
    counted = changes.agg(*report_counters())
    if errors is not None:
        counted = one_row(counted, errors.agg(F.count(F.lit(1)).alias("error_rows")))
    else:
        counted = counted.withColumn("error_rows", F.lit(0).cast("bigint"))
    planned = F.col("processed") if total_rows is None else F.lit(total_rows).cast("bigint")
    seconds = F.coalesce(
        F.lit(finished_at).try_cast("timestamp").cast("double") - F.lit(started_at).try_cast("timestamp").cast("double"), F.lit(0.0))
    return counted.withColumns({
        "errors": F.col("failed") + F.col("error_rows"), "total": planned,
        "skipped": F.greatest(F.lit(0), planned - F.col("processed")),
        "duration_seconds": seconds, "cancelled": F.lit(cancelled)}).drop("failed", "error_rows")


def report_text(report: DataFrame) -> DataFrame:
    """One-line summary of a report."""
    prefix = F.when(F.col("cancelled"), "Recherche abgebrochen").otherwise(F.concat(F.col("processed").cast("string"), F.lit(" Firmen geprüft")))
    line = F.format_string("%s – %d vollständig – %d aktiv – %d nicht aktiv – %d nicht gefunden – %d Fehler",
                           prefix, "complete", "active", "inactive", "not_found", "errors")
    return report.select(line.alias("summary_text"))


def run_summary(results: DataFrame) -> DataFrame:
    """Key of every result with the lists it belongs to: successful, with usable website.

    The lists stay a table; a successful key makes all results of that key successful.
    """
    keyed = results.withColumn("result_key", result_key(F.col("customer_id"), F.col("company"), F.col("city")))
    fine = F.coalesce(F.col("success"), F.lit(True)) & T.is_blank(F.col("error_message"))
    keyed = keyed.withColumns({"successful": fine, "__k": F.concat_ws("|", "result_key.kind", "result_key.key")})
    any_fine = keyed.groupBy("__k").agg(F.max("successful").alias("key_successful"))
    rows = U.with_valid_website(attach(keyed, any_fine, ["__k"]), F.col("website"), "__site")
    return rows.select("result_no", "result_key", "successful",
                       (F.col("key_successful") & (F.col("__site") != "")).alias("with_website"))


def recent_changes(changes: DataFrame, n: int = 5) -> DataFrame:
    """The last n changes."""
    return changes.orderBy(F.desc("result_no")).limit(n)


def customer_of_change(customers: DataFrame, keys: DataFrame) -> DataFrame:
    """First customer row for every report entry, by exact (name, city)."""
    firsts = customers.groupBy(T.as_text(present(customers, V.NAME)).alias("company"),
                               T.as_text(present(customers, V.CITY)).alias("city")).agg(F.min(ROW_NO).alias(ROW_NO))
    return attach(keys.select("company", "city").dropDuplicates(), firsts, ["company", "city"])


# ---------------------------------------------------------------- candidates
def rank_candidates(candidates: DataFrame) -> DataFrame:
    """Website candidates of each company, best first.

    +40 per company word in the domain, +20 in the title, +5 for '.de'; ties keep their order.
    """
    rows = U.with_clean_url(candidates, F.col("url"), "clean_url").filter("clean_url <> ''")
    rows = rows.withColumn("domain", U.bare_host(U.netloc(F.col("clean_url"))))
    rows = rows.filter(~F.col("domain").isin(*V.BLACKLISTED_HOSTS))
    words = F.filter(F.split(T.collapse(F.lower("company_name")), " "), lambda w: F.length(w) >= 3)
    title = F.lower(T.as_text(F.col("title")))
    points = F.aggregate(words, F.lit(0), lambda acc, w: acc
                         + F.when(F.contains(F.col("domain"), w), 40).otherwise(0)
                         + F.when(F.contains(title, w), 20).otherwise(0))
    rows = rows.withColumn("score", points + F.when(F.contains("domain", F.lit(".de")), 5).otherwise(0))
    placed = rows.withColumn("__place", (F.lit(1 << 20) - F.col("score")).cast("bigint") * F.lit(1 << 31) + F.col("pos"))
    return nth_of_key(placed, ["company_name", "city"], "__place", "rank").drop("__place")


def first_accepted_candidate(ranked: DataFrame, use_street_matching: bool = True) -> DataFrame:
    """First candidate whose address agrees; else the reason of the last rejection.

    ``ranked`` carries street, zipcode, city of the request and the candidate's ``addresses``, phone, email.
    """
    state = A.address_state(F.col("street"), F.col("zipcode"), F.col("city"), F.col("addresses"), use_street_matching)
    rows = ranked.withColumn("state", state)
    ok = F.col("state") == "match"
    accepted_reason = (
        F.lit("Firmenname und Ort") if not use_street_matching else
        F.when(A.usable(A.street_name(F.col("street"))), "Adresse plausibel").otherwise("Bisherige Firmenbewertung"))
    reason = F.when(F.col("state") == "missing", "Adresse auf Website nicht gefunden").otherwise("Straße stimmt nicht überein")
    place = F.when(ok, F.col("rank"))
    picked = rows.groupBy("company_name", "city").agg(
        *[F.coalesce(F.min_by(c, place), F.lit("")).alias(o) for c, o in (("clean_url", "website"), ("phone", "phone"), ("email", "email"))],
        # rank 0 is the stored site of a forced check: it carries no reason of its own
        F.min_by(F.when(F.col("rank") == 0, "").otherwise(accepted_reason), place).alias("__good"),
        F.max_by(reason, F.when(F.col("rank") > 0, F.col("rank"))).alias("__bad"))
    return picked.withColumn("match_reason", F.coalesce("__good", "__bad")).drop("__good", "__bad")


def cached_result(requests: DataFrame, companies: DataFrame, *, force_refresh: bool = False,
                  use_street_matching: bool = True) -> DataFrame:
    """Reuse stored companies unless forced or their street differs.

    Adds ``hit``, the re-validated contacts and ``changed`` where stored values need correction.
    """
    stored = one_per_key(companies, ["company_name", F.coalesce("city", F.lit(""))]).select(
        F.col("company_name").alias("__n"), F.coalesce("city", F.lit("")).alias("__c"), F.col("id").alias("stored_id"),
        *[F.coalesce(c, F.lit("")).alias(f"stored_{c}") for c in (
            "website", "phone", "email", "owner", "status", "source", "last_check", "street")])
    joined = requests.join(stored, (F.col("company_name") == F.col("__n")) & (F.col("city") == F.col("__c")), "left").drop("__n", "__c")
    differs = F.lit(False)
    if use_street_matching:
        differs = A.usable(A.street_name(F.col("street"))) & (A.street_match(F.col("street"), F.col("stored_street")) != "match")
    rows = C.with_phone(joined, F.col("stored_phone"), "phone")
    rows = U.with_clean_url(rows, F.col("stored_website"), "website").withColumn("email", C.email(F.col("stored_email")))
    rows = rows.withColumns({
        "status": C.contact_status(F.col("website"), F.col("phone") != "", F.col("email") != ""),
        "hit": F.col("stored_id").isNotNull() & ~F.lit(force_refresh) & ~differs})
    changed = F.col("hit") & (
        (F.col("website") != F.col("stored_website")) | (F.col("phone") != F.col("stored_phone"))
        | (F.col("email") != F.col("stored_email")) | (F.col("status") != F.col("stored_status")))
    source = F.when(F.col("stored_source") == "", "SQLite").otherwise(F.col("stored_source"))
    return rows.withColumns({"changed": changed, "source": source}).drop("phone_reason", "phone_type")


def research(requests: DataFrame, cache: DataFrame, candidates: DataFrame, parsed: DataFrame, now: str, *,
             force_refresh: bool = False, use_street_matching: bool = True) -> DataFrame:
    """Result of every requested company from cache, candidates and stored pages.

    ``requests`` has company_name, city, street, zipcode, country. Cached companies answer directly; the
    others take their best candidate whose site shows an agreeing address. When forced, the stored site
    goes first among the candidates and must also show a contact. All companies are handled as one set, so
    one without pages or candidates is a row with its reason, never an abort.
    """
    from kontor.operators.enrich import clean_pages
    from kontor.operators.pages import contact_candidates, contact_frontier, site_contacts

    known = cached_result(requests, cache, force_refresh=force_refresh, use_street_matching=use_street_matching)
    names = ["company_name", "city"]
    hits = known.filter("hit").select(
        *names, "street", "zipcode", "country", "website", "phone", "email", F.col("stored_owner").alias("owner"), "status", "source",
        F.col("stored_last_check").alias("last_check"), F.col("stored_id").alias("customer_id"), F.lit("").alias("match_reason"), "changed")
    misses = known.filter("NOT hit").select(
        *names, "street", "zipcode", "country", F.coalesce("stored_owner", F.lit("")).alias("owner"), "stored_id", "stored_website")
    ranked = rank_candidates(candidates.join(misses.select(*names), names, "left_semi")).select(*names, "clean_url", "rank")
    if force_refresh:
        stored = U.with_clean_url(misses, F.col("stored_website"), "clean_url").filter("clean_url <> ''")
        ranked = ranked.unionByName(stored.select(*names, "clean_url", F.lit(0).cast("bigint").alias("rank")))

    pages = clean_pages(parsed)
    found = contact_candidates(pages)
    reached = contact_frontier(pages).select(F.col("url").alias("clean_url"), F.col("page_url").alias("url"), "rank")
    bundles = reached.join(found.drop("site", "pos"), "url").withColumnRenamed("rank", "pos")
    contacts = site_contacts(bundles, ["clean_url"])
    offered = ranked.join(contacts, "clean_url", "left").join(misses.select(*names, "street", "zipcode"), names)
    offered = offered.fillna("", subset=["phone", "email"])
    if force_refresh:
        offered = offered.filter("rank > 0 OR phone <> '' OR email <> ''")
    picked = first_accepted_candidate(offered, use_street_matching)
    fresh = misses.join(picked, names, "left").withColumns({
        **{c: F.coalesce(c, F.lit("")) for c in ("website", "phone", "email")},
        "match_reason": F.coalesce("match_reason", F.lit("Kein passender Webauftritt"))})
    status = C.contact_status(F.col("website"), F.col("phone") != "", F.col("email") != "")
    fresh = fresh.select(
        *names, "street", "zipcode", "country", "website", "phone", "email", "owner", status.alias("status"),
        F.when(F.col("website") == "", "Keine Website").otherwise("Website").alias("source"), F.lit(now[:16]).alias("last_check"),
        F.col("stored_id").alias("customer_id"), "match_reason", F.lit(True).alias("changed"))
    return hits.unionByName(fresh)
