"""Contact walks against a queue that visits one page after another, the numbering plan, and names in any script."""

import random
import unicodedata
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from kontor import vocab as V
from kontor.functions import contacts as C
from kontor.functions import text as T
from kontor.operators import pages
from kontor.sources import tables


def walked(start, links, limit):
    """One page after another; links that name a contact page join the end of the queue."""
    queue, at = [start], 0
    while at < len(queue) and at < limit:
        for href in links.get(queue[at], ()):
            target = urljoin(start, href)
            if target not in queue:
                queue.append(target)
        at += 1
    return queue[:limit]


@pytest.mark.parametrize("limit", [1, 2, 5])
def test_walk_equals_queue(spark, limit):
    rng = random.Random(5)
    rows, links = [], {}
    for k in range(25):
        base = f"https://seite-{chr(97 + k)}.de"
        names = [f"{base}/kontakt/{j}" for j in range(9)]
        for url in [f"{base}/", *rng.sample(names, 7)]:
            hrefs = [rng.choice([f"/kontakt/{rng.randrange(9)}", f"kontakt/{rng.randrange(9)}", "#kontakt", f"{base}/kontakt/{rng.randrange(9)}"])
                     for _ in range(rng.randrange(5))]
            links[url] = [h for h in hrefs if h != "#kontakt"]
            rows.append((len(rows), url, "<title>x</title>" + "".join(f'<a href="{h}">y</a>' for h in hrefs)))
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    parsed = pages.parse_pages(tables.scan_pages(table))
    got = {}
    for r in pages.contact_frontier(parsed, limit).collect():
        got.setdefault(r.url, []).append((r["rank"], r.page_url))
    assert {k: [u for _, u in sorted(v)] for k, v in got.items()} == {url: walked(url, links, limit) for _, url, _ in rows}
    assert pages.contact_frontier(parsed.limit(0), limit).collect() == []


def test_plan_search_equals_longest_prefix(spark):
    leads = {code + lead: k for k, (code, tokens, *_) in enumerate(V.NUMBER_PLAN) for lead in C.spelled_out(tokens)}
    codes, planned = C.spelled_out(V.COUNTRY_CODES), {x[0] for x in V.NUMBER_PLAN}
    assert not any(a != b and b.startswith(a) for a in codes for b in codes)
    rng = random.Random(2)
    numbers = [(rng.choice(["", rng.choice(list(leads)), rng.choice(codes)]) + "".join(rng.choice("0123456789") for _ in range(9)))[:rng.randint(1, 14)]
               for _ in range(4000)]
    found = spark.createDataFrame([(n,) for n in numbers], "n string").select("n", C._plans().find(F.col("n")).alias("plan")).collect()
    for number, plan in found:
        padded = number.ljust(8, "0")
        want = next((leads[padded[:k]] for k in range(8, 0, -1) if padded[:k] in leads), None)
        code = next((c for c in codes if padded.startswith(c)), None)
        if want is None and code is not None and code not in planned:
            assert plan >= len(V.NUMBER_PLAN)
        else:
            assert plan == (-1 if want is None else want), number


def test_plans_are_well_formed():
    for code, tokens, least, most, groups, kind in V.NUMBER_PLAN:
        leads = C.spelled_out(tokens)
        assert len({len(x) for x in leads}) == 1 and code in C.spelled_out(V.COUNTRY_CODES)
        assert kind in ("fixed", "mobile", "hotline", "other") and 0 < least <= most <= 15 - len(code)
        assert groups[-1] == 0 or sum(groups) == most == least, (code, tokens)


def test_any_script_is_composed(spark):
    rng = random.Random(9)
    ranges = [range(0x20, 0x250), range(0x300, 0x370), range(0x370, 0x530), range(0x5D0, 0x650), range(0x1100, 0x1200), range(0x1E00, 0x2000),
              range(0x2460, 0x2500), range(0x3040, 0x3400), range(0xAC00, 0xAC80), range(0xF900, 0xFB10), range(0xFF00, 0xFFA0)]
    values = ["".join(chr(rng.choice(rng.choice(ranges))) for _ in range(8)) for _ in range(1500)]
    values = [v for v in values if any(ord(c) > 0xFF for c in v)]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", T.nfkc_any(F.col("v")).alias("n")).collect()
    other = [r for r in rows if any(ord(c) >= 0x250 for c in r.v)]
    assert len(other) > 1000
    wrong = [(ascii(r.v), ascii(r.n)) for r in rows if r.n != unicodedata.normalize("NFKC", r.v)]
    assert not wrong, wrong[:5]
