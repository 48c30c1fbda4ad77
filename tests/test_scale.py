"""Steps that must not grow with the table on the driver or in one task: plans and batch sizes on small tables."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kontor import vocab as V
from kontor.functions import address as A
from kontor.functions import text as T
from kontor.operators import enrich, merge, quality, refresh, research, similarity
from kontor.session import tune, written
from kontor.sources import tables
from kontor.streaming import streams


@pytest.fixture
def tuned(spark):
    """The session as queries set it, from a driver's defaults; put back afterwards."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = {n: spark.conf.get(n, None) for n in names}
    spark.conf.set(names[0], "10m")
    spark.conf.unset(names[1])
    spark.conf.unset(names[2])
    yield tune(spark)
    for n, value in before.items():
        spark.conf.unset(n) if value is None else spark.conf.set(n, value)


def planned(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_exploded_sides_are_not_broadcast_by_the_size_of_their_file(tuned, tmp_path):
    # a small file whose rows explode into many signatures or grams
    tuned.sql("SELECT id AS row_no, concat('firma ', id, ' ', repeat('x', 20)) AS n_name, 'ort' AS n_city FROM range(2000)").write.parquet(f"{tmp_path}/names")
    rows = tuned.read.parquet(f"{tmp_path}/names")
    assert "Broadcast" not in planned(similarity.blocked_similar(rows))
    assert "Broadcast" not in planned(similarity.similar_names(rows.select(rows.n_name.alias("name")).limit(200)))


def test_components_forget_the_size_estimates_of_their_rounds(tuned):
    chain = tuned.createDataFrame([(k, k + 1) for k in range(120)], "row_a long, row_b long")
    found = similarity.connected_components(chain)
    assert {r.component for r in found.collect()} == {0} and found.count() == 121
    size = found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert len(str(size)) < 10, "each round multiplied the estimate of the round before"


def test_addresses_are_folded_once(spark):
    rows = spark.sql("SELECT 'Hauptstraße 3 a' AS a, 'Hauptstr. 3A' AS b, array(named_struct('street', 'Hauptstr. 3a', 'zipcode', '01067', 'city', 'Dresden')) AS found")
    matched = rows.select(A.street_match(F.col("a"), F.col("b")).alias("m"))
    agreed = rows.select(A.address_state(F.col("a"), F.lit("01067"), F.lit("DRESDEN"), F.col("found")).alias("m"))
    for df in (matched, agreed):
        assert df.first().m == "match"
        # two texts, each folded in one place
        assert df._jdf.queryExecution().analyzed().toString().count("strasse)") <= 2


def test_titles_of_the_sql_decode_references_as_the_parser_does(tmp_path):
    import duckdb

    from __spark_entry__ import oracle_sql
    from kontor.functions.html import read_page

    titles = ["a &amp; b", "token = &quot;x", "cut &amp", "cut &quot", "&lt;b&gt;", "it&#x27;s", "&amp;quot;", "plain &am"]
    pages = [(k, f"<html><title>{t}</title></html>") for k, t in enumerate(titles)]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id bigint, html varchar)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", pages)
    stated = {r[0]: r[1] for r in con.execute(oracle_sql()["parse_pages"]).fetchall()}
    assert stated == {k: read_page("", html)["title"] for k, html in pages}


def test_a_python_worker_holds_few_pages_at_a_time(tuned):
    rows = tuned.range(0, 3000, 1, 1)
    sizes = [r.n for r in rows.mapInPandas(lambda batches: (b.assign(n=len(b))[["n"]] for b in batches), "n long").collect()]
    assert len(sizes) == 3000 and max(sizes) <= 500


def test_conflicting_values_explode_behind_the_only_shuffle(spark):
    fields = ", ".join(f"cast(id % 3 AS string) AS {f}" for f in merge._CONFLICTING)
    companies = spark.sql(f"SELECT id, concat('Firma ', id % 10) AS company_name, 'Ort' AS city, {fields} FROM range(100)")
    listed = merge.company_conflicts(companies)
    assert listed._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(") == 1
    assert {tuple(r["values"]) for r in listed.collect()} == {("0", "1", "2")} and listed.count() == 10 * len(merge._CONFLICTING)


def test_name_groups_normalise_every_cell_once_and_in_many_tasks(spark):
    rows = spark.sql("""SELECT id AS row_no, CASE WHEN id % 5 = 4 THEN ' ' ELSE concat('Firma ', id % 5) END AS KUNDENNAME, 'Ort' AS CITY,
        CASE WHEN id = 1 THEN 'a@firma-eins.de' ELSE '' END AS EMAIL FROM range(0, 50, 1, 1)""")
    groups = quality.name_groups(quality.normalize_rows(rows), ["KUNDENNAME", "CITY", "EMAIL"])
    plan = groups._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "REPARTITION_BY_NUM" in plan
    assert {(r.n_name, r.size, r.category) for r in groups.collect()} == {(f"firma {k}", 10, "safe" if k == 1 else "identical") for k in range(4)}


def test_plain_text_is_not_searched_for_other_scripts(spark):
    rows = spark.createDataFrame([("Firma Ä",), ("Ｆｉｒｍａ",), ("ｶﾞ GmbH",), (None,)], "name string").select(T.text(F.col("name")).alias("t"))
    assert [r.t for r in rows.collect()] == ["Firma Ä", "Firma", "ガ GmbH", ""]
    kernel = rows._jdf.queryExecution().executedPlan().toString().partition("_normalized(")[2]
    assert kernel.index(T._NON_ASCII) < kernel.index(T._OTHER_SCRIPT[:14])


def test_customers_and_results_are_not_broadcast_by_the_size_of_their_file(tuned, tmp_path):
    tuned.sql("SELECT id AS row_no, id AS ID, concat('firma ', id) AS KUNDENNAME, 'ort' AS CITY, 'Weg 1' AS STRASSE, 'https://alt.de' AS WEBSITE, 'Hotel' AS INDUSTRY FROM range(2000)").write.parquet(f"{tmp_path}/customers")
    tuned.sql("""SELECT c.id AS result_no, concat('firma ', c.id) AS company, 'ort' AS city, c.id AS customer_id, 'Weg 1' AS street, 'https://neu.de' AS website, '' AS phone, '' AS email,
        'Aktiv' AS status, 'Website' AS source, '' AS last_check FROM range(500) c""").write.parquet(f"{tmp_path}/results")
    customers, results = (tuned.read.parquet(f"{tmp_path}/{name}") for name in ("customers", "results"))
    applied = research.apply_results(customers, results.join(customers.select(F.col("ID").alias("customer_id")), "customer_id"))
    assert "Broadcast" not in planned(applied)
    assert applied.filter("WEBSITE = 'https://neu.de' AND INDUSTRY = ''").count() == 500


def test_a_merge_normalises_and_ranks_the_companies_once(spark):
    fields = ", ".join(f"CASE WHEN id % 2 = 0 THEN '' ELSE 'x' END AS {f}" for f in V.MERGE_FIELDS)
    companies = spark.sql(f"SELECT id, concat('Firma ', id DIV 2) AS company_name, 'Ort' AS city, {fields} FROM range(10)")
    activities = spark.sql("SELECT id, 2 * id AS company_id, '' AS company_key, '' AS company_name, '' AS city FROM range(2)")
    merged = merge.merge_companies(companies, activities)["companies"]
    assert merged._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 0
    assert sorted(r.id for r in merged.collect()) == [0, 2, 5, 7, 9]


def test_a_stream_of_results_broadcasts_no_side_by_the_size_of_its_file(tuned, tmp_path, monkeypatch):
    tuned.sql("SELECT id AS row_no, id AS ID, concat('firma ', id) AS KUNDENNAME, 'ort' AS CITY, 'Weg 1' AS STRASSE, 'https://alt.de' AS WEBSITE FROM range(2000)").write.parquet(f"{tmp_path}/customers")
    customers, plans, done = tuned.read.parquet(f"{tmp_path}/customers"), [], []

    def applied(table, batch):
        plans.append(planned(out := research.apply_results(table, batch)))
        return out

    monkeypatch.setattr(streams, "apply_results", applied)
    for no in (1, 2):
        tuned.sql(f"""SELECT {no} * 1000 + id AS result_no, concat('firma ', id) AS company, 'ort' AS city, id AS customer_id, 'Weg 1' AS street, 'https://neu{no}.de' AS website, '' AS phone, '' AS email,
            'Aktiv' AS status, 'Website' AS source, '' AS last_check FROM range({no} * 100)""").write.mode("append").parquet(f"{tmp_path}/results")
        arriving = tuned.readStream.schema(tuned.read.parquet(f"{tmp_path}/results").schema).parquet(f"{tmp_path}/results")
        run = streams.stream_apply_results(arriving, lambda: tuned.read.parquet(done[-1]) if done else customers, f"{tmp_path}/applied", done.append)
        run.option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
    assert len(plans) == 2 and not any("Broadcast" in plan for plan in plans)
    assert tuned.read.parquet(done[-1]).groupBy("WEBSITE").count().sort("WEBSITE").collect() == [("https://alt.de", 1800), ("https://neu2.de", 200)]


def test_similar_pairs_and_their_statistics_broadcast_no_side_by_the_size_of_its_file(tuned, tmp_path):
    tuned.sql("SELECT concat('firma ', id DIV 2, ' ', repeat('x', 20)) AS KUNDENNAME, 'ort' AS CITY FROM range(400)").write.parquet(f"{tmp_path}/names")
    rows = tuned.read.parquet(f"{tmp_path}/names")
    pairs = similarity.similar_pairs(rows)
    assert "Broadcast" not in planned(pairs)
    statistics = similarity.duplicate_statistics(rows)
    assert "Broadcast" not in planned(statistics)
    listed = pairs.agg(F.sum("row_pairs")).first()[0]
    assert statistics.first().asDict() == {"rows": 400, "exact_duplicates": 400, "similar_duplicates": 2 * listed} and listed >= 200


def test_similar_pairs_leave_their_blocks_finished(tuned, tmp_path, monkeypatch):
    monkeypatch.setattr(similarity, "SHARD_ROWS", 8)
    long = "straße " * 9
    names = [f"{long[:n]}{end}" for n in (0, 30, 56, 63) for end in ("haus", "haus a", "haus ab", "häuser", "handel")] + ["a" * 64, "a" * 65, "b" + "a" * 63]
    tuned.createDataFrame([(n,) for n in names], "KUNDENNAME string").write.parquet(f"{tmp_path}/names")
    pairs = similarity.similar_pairs(tuned.read.parquet(f"{tmp_path}/names"))
    plan = planned(pairs)
    assert plan.index("MapInArrow") < plan.index("Join")  # nothing is joined to the pairs
    wanted = {(a, b, similarity._score(a, b)) for a in names for b in names if a < b and similarity._score(a, b) >= 90}
    assert sorted((r.name_a, r.name_b, r.match) for r in pairs.collect()) == sorted(wanted) and len(wanted) > 20


def test_statistics_sum_their_pairs_where_they_are_found(tuned, tmp_path, monkeypatch):
    monkeypatch.setattr(similarity, "SHARD_ROWS", 16)
    tuned.sql("SELECT concat('firma ', id % 60, ' handel') AS KUNDENNAME, 'ort' AS CITY FROM range(100)").write.parquet(f"{tmp_path}/names")
    rows = tuned.read.parquet(f"{tmp_path}/names")
    statistics = similarity.duplicate_statistics(rows)
    assert "name_a" not in planned(statistics)  # no pair leaves its blocks
    assert statistics.first().similar_duplicates == 2 * similarity.similar_pairs(rows).agg(F.sum("row_pairs")).first()[0]


def test_a_block_of_names_goes_to_its_tasks_and_not_with_every_block_it_meets(tuned, monkeypatch):
    monkeypatch.setattr(similarity, "SHARD_ROWS", 4)
    monkeypatch.setattr(similarity, "_STRIPS", 4, raising=False)
    names, moved = [(f"{no:03} gesellschaft",) for no in range(80)], []
    frame = type(tuned.range(1))
    mapped = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda df, *args: moved.append(df) or mapped(df, *args))
    found = similarity.similar_names(tuned.createDataFrame(names, "name string"))
    rows = [F.size(c) for c, kind in moved[0].dtypes if kind.startswith("array")]
    assert moved[0].agg(F.sum(sum(rows[1:], rows[0]))).first()[0] <= 4 * 80  # once a strip at most; with every block it was 28 times
    assert found.count() == sum(similarity._score(a, b) >= 90 for (a,) in names for (b,) in names if a < b)


def test_names_are_compared_by_what_they_have_in_common_and_not_pair_by_pair(monkeypatch):
    names = [f"Firma {a}{b}{c}{d} Handelsgesellschaft" for a in "abcdef" for b in "ghijkl" for c in "mnopqr" for d in "stuvwx"]
    block = similarity._Block(pa.StructArray.from_arrays([pa.array(names), pa.array([1] * len(names))], names=["name", "n"]))
    steps, advanced = [], similarity._advanced
    monkeypatch.setattr(similarity, "_advanced", lambda *args: steps.append(len(args[7])) or advanced(*args))
    found = [(int(i), int(j)) for left, right, match in similarity._similar(block, block, True, 95) for i, j in zip(left, right)]
    assert len(found) == len(set(found)) == sum(sum(x != y for x, y in zip(a, b)) == 1 for a in names for b in names) // 2 == 12960
    assert sum(steps) < 0.1 * len(names) * (len(names) - 1) / 2  # letters of two nodes; one by one, every pair has one at least


def test_no_level_holds_more_nodes_than_two_steps(monkeypatch):
    monkeypatch.setattr(similarity, "_PAIRS_AT_ONCE", 50)
    names = [f"{a}{b}{c}{d} Handel" for a in "abcdef" for b in "ghijkl" for c in "mnopqr" for d in "stuvwx"]
    block = similarity._Block(pa.StructArray.from_arrays([pa.array(names), pa.array([1] * len(names))], names=["name", "n"]))
    held, children = [], similarity._children
    monkeypatch.setattr(similarity, "_children", lambda *args: held.append(len(args[5])) or children(*args))
    assert sum(len(left) for left, _, _ in similarity._similar(block, block, True, 90)) == 12960
    assert 50 <= max(held) <= 100


def test_changed_pages_are_parsed_in_all_tasks_and_meet_their_candidates_without_a_join(spark, monkeypatch):
    plans = {}

    def recorded(df, name):
        plans[name] = df._jdf.queryExecution().sparkPlan().toString()
        return written(df, name)

    monkeypatch.setattr(refresh, "written", recorded)
    monkeypatch.setattr(enrich, "written", recorded)
    pages = tables.scan_pages(spark.sql("""SELECT 2 * id AS page_id, concat('https://firma-', id, '.de/') AS url, '<title>Start</title><a href="/impressum">Impressum</a><p>Telefon: 030 200001</p>' AS html FROM range(0, 3, 1, 1)
        UNION ALL SELECT 2 * id + 1, concat('https://firma-', id, '.de/impressum'), '<title>Impressum</title><a href="mailto:info@firma.de">m</a>' FROM range(0, 3, 1, 1)"""))
    requests = spark.sql("SELECT id AS result_no, concat('Firma ', id) AS company, 'Berlin' AS city, concat('https://firma-', id, '.de') AS website, id AS customer_id FROM range(3)")
    facts = {f["key"]: f["achieved"] for f in refresh.refresh_analysis(requests, pages, None, "2024-01-20").first().result.website_score_details.criteria}
    assert facts["phone"] and facts["email"] and facts["imprint"]
    assert "REPARTITION_BY_NUM" in plans["parsed"]
    assert plans["site-pages"].count("Join") == 3  # start pages, their links, the pages reached
