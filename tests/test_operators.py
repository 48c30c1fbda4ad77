"""Composite operators on literal rows, brute force and skew checks."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from kontor import vocab as V
from kontor.operators import common, enrich, filters, imprint, merge, pages, quality, research, similarity
from kontor.sources import tables

IMPORT = "row_no long, KUNDENNAME string, CITY string, TELEFON string, EMAIL string, WEBSITE string"


def lcs_ratio(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return 200 * table[-1][-1] / (len(a) + len(b)) if a or b else 100


def test_import_pipeline(spark):
    df = spark.createDataFrame([
        (0, " Müller   GmbH ", "Köln", None, None, None), (1, "müller gmbh", " KÖLN ", None, None, None),
        (2, "Firma", "Berlin", "030 123456", None, None), (3, "Firma", "Berlin", None, "info@firma.de", "firma.de"),
        (4, "Mustertechnik GmbH", "Berlin", None, None, None), (5, "Mustertechnk GmbH", "Berlin", None, None, None),
        (6, "", "", "9 50189", "bad@@mail", "firma.de"), (7, None, None, None, None, None)], IMPORT)
    parts = quality.analyze_import(df)
    assert sorted((r.category, r.size) for r in parts["groups"].collect()) == [("identical", 2), ("safe", 2), ("unsafe", 2)]
    s = parts["summary"].first()
    assert (s.total_rows, s.empty_rows, s.invalid_phones, s.invalid_emails, s.missing_customer_name, s.identical_duplicates) == (8, 1, 1, 1, 1, 1)
    merged = {r.row_no: r for r in quality.merge_groups(df).collect()}
    assert 2 not in merged and merged[3].TELEFON == "030 123456" and 1 not in merged
    cleaned = {r.row_no: r for r in quality.clean_rows(quality.merge_groups(df)).collect()}
    assert set(cleaned) == {0, 3, 4, 5} and cleaned[3].WEBSITE == "https://firma.de"
    with pytest.raises(ValueError):
        quality.analyze_import(df.drop("KUNDENNAME"))


def test_master_override(spark):
    df = spark.createDataFrame([(0, "A", "B", None, None, "https://firma.de"), (1, "A", "B", "030 123456", "i@firma.de", None)], IMPORT)
    group = quality.name_groups(quality.normalize_rows(df), common.data_columns(df)).first()
    assert group.master_row == 1
    chosen = spark.createDataFrame([(group.group_id, 0)], "group_id string, master_row long")
    assert [(r.row_no, r.TELEFON) for r in quality.merge_groups(df, chosen).collect()] == [(0, "030 123456")]
    wrong = spark.createDataFrame([(group.group_id, 9)], "group_id string, master_row long")
    with pytest.raises(Exception, match="Hauptzeile"):
        quality.merge_groups(df, wrong).collect()


def test_score_and_empty_table(spark):
    df = spark.createDataFrame([(0, "A", "B", "030 123456", "info@firma.de", "firma.de"), (1, "C", None, None, None, None)], IMPORT)
    assert quality.dashboard_quality(df).first().quality_score == 70
    assert tuple(quality.dashboard_quality(df.limit(0)).first()) == (0, 0, 0, 0)


@pytest.mark.parametrize("threshold", [90, 80, 70])
def test_similarity_join_equals_all_pairs(spark, threshold):
    rng = random.Random(7)
    stems = ["Mustertechnik", "Musterhandel", "Bäckerei Schulz", "Firma Meier", "Autohaus Nord", "Al", "A"]
    names = set()
    while len(names) < 150:
        text = list(rng.choice(stems) + rng.choice([" GmbH", " AG", "", " KG"]))
        for _ in range(rng.randint(0, 3)):
            place = rng.randrange(len(text) + 1)
            if rng.random() < 0.5:
                text.insert(place, rng.choice("abcdä "))
            elif text and place < len(text):
                text.pop(place)
        names.add("".join(text))
    names.discard("")
    found = {(r.name_a, r.name_b) for r in similarity.similar_names(spark.createDataFrame([(n,) for n in names], "name string"), threshold).collect()}
    wanted = {tuple(sorted(p)) for p in itertools.combinations(names, 2) if lcs_ratio(*p) >= threshold}
    assert {tuple(sorted(p)) for p in found} == wanted


def test_similar_pairs_shards(spark, monkeypatch):
    monkeypatch.setattr(similarity, "SHARD_ROWS", 3)
    names = [f"Firma {a}{b} Handel" for a in "abcdef" for b in "uvwxyz"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names + names[:5])], "row_no long, KUNDENNAME string")
    rows = similarity.similar_pairs(df).collect()
    wanted = {p for p in itertools.combinations(sorted(names), 2) if lcs_ratio(*p) >= 90}
    assert {tuple(sorted((r.name_a, r.name_b))) for r in rows if r.name_a != r.name_b} == wanted
    assert sum(r.row_pairs for r in rows if r.name_a == r.name_b) == 5
    assert similarity.expand_pairs(df, similarity.similar_pairs(df)).count() == sum(r.row_pairs for r in rows)


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [tuple(sorted(rng.sample(range(100, 160), 2))) for _ in range(40)]
    parent = {v: v for e in edges for v in e}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        ra, rb = sorted((root(a), root(b)))
        parent[rb] = ra
    found = {r.vertex: r.component for r in similarity.connected_components(spark.createDataFrame(edges, "row_a long, row_b long")).collect()}
    assert found == {v: root(v) for v in parent}


def test_attach_splits_a_hot_key(spark):
    settings = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
                "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 200_000, 1, 8).withColumn("k", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")))
        stats = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        joined = common.attach(rows, stats, ["k"])
        assert joined.count() == 200_000
        joined.write.format("noop").mode("overwrite").save()
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_nth_of_key_across_slices(spark, monkeypatch):
    monkeypatch.setattr(common, "RANK_BUCKET", 4)
    rows = [("a" if i % 3 else "b", i) for i in range(30)]
    out = common.nth_of_key(spark.createDataFrame(rows, "k string, row_no long"), ["k"]).collect()
    wanted = {(k, i): sum(1 for k2, j in rows if k2 == k and j <= i) for k, i in rows}
    assert {(r.k, r.row_no): r.nth for r in out} == wanted


def test_row_order_does_not_matter(spark):
    data = [(i, f"Firma {i % 5}", "X", "030 123456" if i % 4 else None, None, None) for i in range(40)]
    straight = spark.createDataFrame(data, IMPORT)
    shuffled = spark.createDataFrame(data[::-1], IMPORT).repartition(7)
    for run in (quality.merge_groups, quality.dashboard_quality, quality.repeat_flag):
        assert sorted(map(str, run(straight).collect())) == sorted(map(str, run(shuffled).collect()))


def test_results_address_rows_in_tiers(spark):
    customers = spark.createDataFrame([(0, 10, "A", "X", "Hauptstr. 1", "alt"), (1, 20, "A", "X", "Nebenweg 2", "alt"), (2, 30, "A", "Y", None, "alt")],
                                      "row_no long, ID long, KUNDENNAME string, CITY string, STRASSE string, WEBSITE string")
    def run(*results):
        frame = spark.createDataFrame([(n, "A", "X", cid, street, site, "", "", "Aktiv", "Website", "") for n, cid, street, site in results],
            "result_no long, company string, city string, customer_id long, street string, website string, phone string, email string, status string, source string, last_check string")
        return [r.WEBSITE for r in research.apply_results(customers, frame).orderBy("row_no").collect()]

    assert run((1, 20, "", "neu")) == ["alt", "neu", "alt"]
    assert run((1, None, "Nebenweg 2", "neu")) == ["alt", "neu", "alt"]
    assert run((1, None, "", "neu")) == ["neu", "neu", "alt"]
    assert run((1, None, "", "neu"), (2, 10, "", "neuer")) == ["neuer", "neu", "alt"]


def test_company_merge(spark):
    base = {f: "" for f in V.MERGE_FIELDS}
    make = lambda i, name, **kw: {"id": i, "company_name": name, "city": "Köln", **base, **kw}
    companies = spark.createDataFrame([
        make(1, "Müller GmbH", tags="A", notes="eins", next_follow_up_at="2024-02-02"), make(2, "MÜLLER GMBH", tags="a, B", notes="zwei", next_follow_up_at="2024-02-01"),
        make(3, "Rest", owner="x"), make(4, "rest", owner="y")])
    activities = spark.createDataFrame([(7, "müller gmbh köln", 1, "Müller GmbH", "Köln")], "id long, company_key string, company_id long, company_name string, city string")
    out = merge.merge_companies(companies, activities)
    rows = {r.id: r for r in out["companies"].collect()}
    assert set(rows) in ({1, 3, 4}, {2, 3, 4})
    kept = rows.get(1) or rows[2]
    assert kept.tags == "A, B" and kept.notes == "eins" + V.NOTES_SEPARATOR + "zwei" and kept.next_follow_up_at == "2024-02-01"
    assert out["activities"].first().company_id == kept.id and out["rejected"].count() == 1
    fixed = spark.createDataFrame([(3, "owner", "z")], "group_id long, field string, value string")
    assert "z" in {r.owner for r in merge.merge_companies(companies, activities, fixed)["companies"].collect()}


def test_phone_cleanup(spark):
    companies = spark.createDataFrame([(1, "A", "B", "https://a.de", "9 50189", "info@firma.de", "Vollständig")],
                                      "id long, company_name string, city string, website string, phone string, email string, status string")
    item = merge.phone_cleanup_preview(companies).first()
    assert (item.after, item.rating, item.status_after) == ("", "ungültig", "Aktiv")


HOME = """<html><head><title>Bäckerei Beispiel Berlin</title><meta name="description" content="Unsere Bäckerei bietet täglich Backwaren und ein kleines Café in Berlin.">
<script type="application/ld+json">{"@type":"Bakery","openingHoursSpecification":[{"dayOfWeek":["Monday","Tuesday"],"opens":"08:00","closes":"18:00"}]}</script></head>
<body><h1>Bäckerei Beispiel</h1><p>Telefon: 030 123456 E-Mail: info@beispiel.de</p><a href="/impressum">Impressum</a><a href="/datenschutz">Datenschutz</a><a href="/kontakt">Kontakt</a>
<a href="https://instagram.com/beispiel?utm_source=web">I</a><a href="https://facebook.com/sharer?id=1">T</a></body></html>"""
NOTICE = """<html><title>Impressum</title><body><dl><dt>Firma:</dt><dd>Beispiel GmbH</dd><dt>Anschrift</dt><dd>Musterstr. 12, 01067 Dresden</dd></dl>
<p>Geschäftsführer: Dr. Max Müller und Erika Muster</p><p>Telefon: 030 123456</p><p>Telefax: 030 999999</p><p>USt-IdNr.: DE 123 456 789</p>
<p>Amtsgericht Dresden, HRB 12345</p><a href="mailto:webmaster@x.de">w</a><a href="mailto:info@beispiel.de">m</a></body></html>"""


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(0, "beispiel.de", "https://beispiel.de/", HOME, 0.1), (1, "beispiel.de", "https://beispiel.de/kontakt", "<title>Kontakt</title><form></form>", 0.1),
            (2, "beispiel.de", "https://beispiel.de/impressum", NOTICE, 0.1), (3, "beispiel.de", "https://beispiel.de/datenschutz", "<title>Datenschutz</title>", 0.1)]
    return pages.parse_pages(spark.createDataFrame(rows, "pos long, site string, url string, html string, elapsed double"))


def test_site_analysis(spark, parsed):
    requests = spark.createDataFrame([(1, "Bäckerei Beispiel", "Berlin", "https://beispiel.de", 7), (2, "X", "Y", "https://fehlt.de", None), (3, "Z", "Q", "https://z.de/a.pdf", None)],
                                     "result_no long, company string, city string, website string, customer_id long")
    rows = {r.result_no: r.result for r in enrich.analyze_sites(requests, parsed, "2024-01-01T00:00:00+00:00").collect()}
    r = rows[1]
    assert (r.website_score, r.website_score_category, r.industry.industry) == (100, "Sehr gut", "Bäckerei")
    assert r.social_media.instagram == "https://instagram.com/beispiel" and r.social_media.facebook == ""
    assert [(e.day, e.periods) for e in r.opening_hours.entries] == [("Montag", ["08:00–18:00"]), ("Dienstag", ["08:00–18:00"])]
    i = r.imprint_data
    assert i.managing_director_names == ["Dr. Max Müller", "Erika Muster"] and i.legal_form == "GmbH" and i.imprint_city == "Dresden"
    assert (i.imprint_phone, i.imprint_email, i.vat_id, i.commercial_register_number) == ("+49 30 123456", "info@beispiel.de", "DE123456789", "12345")
    assert rows[2].enrichment_status == rows[3].enrichment_status == "Fehler" and "Dokument" in rows[3].enrichment_error


def test_written_hours(spark):
    df = spark.createDataFrame([("Montag: 08:00-12:00 und 13.00-18:00 Mittwoch: geschlossen Donnerstag: nach Vereinbarung Tuesday: 09:00 to 17:00",), ("ab und zu offen",)], "t string")
    first, second = [r.h for r in enrich.with_visible_hours(df, F.col("t"), "h").collect()]
    assert [(e.day, e.periods, e.closed, e.by_appointment) for e in first] == [
        ("Montag", ["08:00–12:00", "13:00–18:00"], False, False), ("Dienstag", ["09:00–17:00"], False, False),
        ("Mittwoch", [], True, False), ("Donnerstag", [], False, True)]
    assert second == []


def test_broken_markup(spark):
    from kontor.functions.html import read_page

    page = read_page("https://x.de/", "<p><b>eins<br><p>zwei <script>var t='</p>'</script><div hidden>weg</div><a href=x>l</a>")
    assert page["visible_text"] == "eins zwei l" and page["links"][0]["url"] == "https://x.de/x"


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, "A", "01067"), (1, "B", "61462.0")], "row_no long, KUNDENNAME string, PLZ string")
    path = tables.write_customers(df, str(tmp_path / "out"), "csv")
    back = tables.load_customers(spark, path)
    assert {r.PLZ for r in back.collect()} == {"01067", "61462"}
    with pytest.raises(ValueError):
        tables.target_path("a.csv", "parquet")
    with pytest.raises(ValueError):
        tables.write_cleaned(df, df, "/a/b", "/a/b/")
    changes = spark.createDataFrame([("A", "B", "", "w", "", "", "", "", "", "Aktiv", ["website"], True, "")], tables.CHANGE_SCHEMA)
    errors = spark.createDataFrame([("C", "D", "kaputt")], "company string, city string, message string")
    tables.write_report_json(research.research_report(changes), changes, errors, str(tmp_path / "report"))
    _, read_changes, read_errors = tables.read_report(spark, str(tmp_path / "report"))
    assert read_changes.collect() == changes.collect() and read_errors.collect() == errors.collect()
    tables.write_report(changes, research.research_report(changes), str(tmp_path / "view"), filter_name="changed")
    assert tables.write_import_report(errors, str(tmp_path / "r")).endswith(".json")


def test_streaming_results(spark, tmp_path):
    from kontor.streaming import streams

    schema = ("result_no long, company string, city string, customer_id long, street string, website string, phone string, email string, "
              "status string, source string, last_check string")
    for n, site in ((1, "https://eins.de/"), (2, "https://zwei.de/")):
        spark.createDataFrame([(n, "A", "X", None, "", site, "", "", "Aktiv", "Website", "")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    customers = spark.createDataFrame([(0, "A", "X", "alt")], "row_no long, KUNDENNAME string, CITY string, WEBSITE string")
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    run = streams.stream_apply_results(stream, lambda: customers, str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert [r.WEBSITE for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["https://zwei.de/"]


def test_changed_website_makes_analysis_stale(spark):
    customers = spark.createDataFrame([(0, "A", "X", "https://alt.de/", "Hotel"), (1, "B", "X", "https://b.de", "Hotel")],
                                      "row_no long, KUNDENNAME string, CITY string, WEBSITE string, INDUSTRY string")
    results = spark.createDataFrame([(1, "a", "x", None, "", "https://neu.de/", "", "", "Aktiv", "Website", ""), (2, "B", "X", None, "", "https://b.de", "", "", "Aktiv", "Website", "")],
        "result_no long, company string, city string, customer_id long, street string, website string, phone string, email string, status string, source string, last_check string")
    assert [r.company_key for r in research.stale_keys(customers, results).collect()] == ["a x"]
    assert [r.INDUSTRY for r in research.apply_results(customers, results).orderBy("row_no").collect()] == ["", "Hotel"]


def test_cleanup_filter(spark):
    rows = [(1, "9 50189", "ungültig", "", "Aktiv", "Aktiv"), (2, "030 123456", "gültig", "+49 30 123456", "Aktiv", "Vollständig")]
    items = spark.createDataFrame(rows, "company_id long, before string, rating string, after string, status_before string, status_after string")
    kept = lambda mode: [r.company_id for r in filters.cleanup_filter(items, mode).orderBy("company_id").collect()]
    assert (kept("all"), kept("invalid"), kept("changed"), kept("status")) == ([1, 2], [1], [1, 2], [2])


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_new_ids_lose_no_row(spark, adaptive):
    from kontor.sources.tables import next_ids

    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        n = 1_000_000
        wide = spark.range(n).select(F.md5(F.col("id").cast("string")).alias("name"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 3).alias("note"))
        old = spark.createDataFrame([(41,)], "id long")
        got = next_ids(wide.repartition(7), old, ["name"]).agg(
            F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.min("id").alias("low"), F.max("id").alias("high")).first()
        assert tuple(got) == (n, n, 42, 41 + n)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_lookup_sides_are_unique(spark):
    from kontor.operators import crm
    from kontor.sources.tables import upsert

    columns = "id long, company_name string, city string, " + ", ".join(f"{c} string" for c in V.CRM_DEFAULTS)
    blank = [""] * len(V.CRM_DEFAULTS)
    stored = spark.createDataFrame([(1, "A", None, *blank), (2, "A", "", *blank)], columns)
    customers = spark.createDataFrame([("A", "")], "KUNDENNAME string, CITY string")
    assert crm.with_crm(customers, stored).count() == 1
    orphan = spark.createDataFrame([(5, None, "A", "")], "id long, company_id long, company_name string, city string")
    assert [r.company_id for r in crm.link_orphans(orphan, stored).collect()] == [1]
    changes = spark.createDataFrame([("A", "", "x"), ("A", None, "y"), ("B", "", "z"), ("B", "", "w")], "company_name string, city string, notes string")
    result = upsert(stored.limit(1).select("id", "company_name", "city", "notes"), changes, ["company_name", "city"], ["notes"], "2024-01-01")
    assert sorted((r.company_name, r.notes) for r in result.collect()) == [("A", "y"), ("B", "z")]


def test_results_are_fed_in_two_batches_of_many_files(spark, monkeypatch):
    import types

    from kontor.plans import catalog, roundtrip_catalog

    paths, fresh = {}, roundtrip_catalog.fresh_path
    monkeypatch.setattr(roundtrip_catalog, "fresh_path", lambda s, name: paths.setdefault(name, fresh(s, name)))
    i = catalog.Inputs(spark, "/root/testdata/sf0.001")
    few = types.SimpleNamespace(spark=spark, results=i.results.repartition(4), customers=i.customers)
    assert roundtrip_catalog._stream_results(few).count() == i.customers.count()
    assert len(spark.read.parquet(paths["results"]).inputFiles()) > 2
    assert spark.read.parquet(paths["applied"]).select("batch_id").distinct().count() == 2
