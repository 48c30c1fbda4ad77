"""The rank index against plain offsets, and examples against a plain version."""

import hashlib
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kontor.llm import fill_middle


def index_of(texts):
    held, offsets, edges = fill_middle.line_boundaries(pa.array(texts, pa.large_string()))
    return held, offsets, edges, fill_middle.RankIndex(offsets, edges)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("\n\nab é\U0001F600"), max_size=60), max_size=6))
def test_boundaries_of_any_texts(texts):
    held, offsets, edges, index = index_of(texts)
    assert held.tobytes() == "".join(texts).encode()
    base = 0
    for text, start, stop in zip(texts, edges, edges[1:]):
        ends = [base + len(text[:m.end()].encode()) for m in re.finditer(r"[^\n]*\n|[^\n]+", text)]
        assert offsets[start:stop].tolist() == [base, *ends]
        base += len(text.encode())
    assert np.array_equal(index.at(np.arange(len(offsets))), offsets)


def test_few_segments_and_bounded_residuals():
    rng = np.random.default_rng(4)
    even = "".join("x" * int(k) + "\n" for k in rng.integers(38, 42, 20_000))
    jumpy = "".join("x" * int(k) + "\n" for k in rng.choice([0, 3, 50, 40_000], 3_000, p=[.4, .4, .19, .01]))
    _, offsets, edges, index = index_of([even, "", jumpy, "one line"])
    assert np.array_equal(index.at(np.arange(len(offsets))), offsets)
    segment = np.searchsorted(index.first, np.arange(len(offsets)), side="right") - 1
    off = offsets - index._line(index.base[segment], index.slope[segment], np.arange(len(offsets)) - index.first[segment])
    assert np.abs(off).max() <= fill_middle.BOUND
    assert (index.first < edges[1]).sum() < 200, "a regular text needs few segments"


def plain_example(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k:8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text):
        return len(units), "plain", None, None, text
    output = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 50 else f"<P>{p}<S>{s}<M>{m}"
    return len(units), "spm" if h4 % 100 < 50 else "psm", len(p), len(m), output


def test_documents(spark):
    texts = [None, "", "a", "a\nb\nc", "\n\n\n", "é\n\U0001F600\n日本", "has <P> inside\nx", "a < P\n<\nS>\n", "<\n<P\nM>x", "l\n" * 50_000, "twice\nx", "twice\nx", "y" * 2_000_000]
    rows = [(k or None, x, "x", "y") for k, x in enumerate(texts)] + [(100 + k, f"line {k}\n" * (k % 23) + "end", "x", "y") for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, output string").repartition(3)
    made = fill_middle.examples(docs)
    back = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    got = sorted(tuple(r) for r in back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "back").fillna(-1).collect())
    want = []
    for doc_id, text, *_ in rows:
        n, form, prefix, middle, output = plain_example(doc_id, text)
        want.append((-1 if doc_id is None else doc_id, n, form, -1 if prefix is None else prefix, -1 if middle is None else middle, output, text or ""))
    assert got == sorted(want)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.examples(docs.limit(0)).collect() == []


def test_shares(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a\nb\nc\nd").alias("text"))
    forms = {r.form: r["count"] for r in fill_middle.examples(docs, cut_percent=40, suffix_first=25).groupBy("form").count().collect()}
    assert abs(forms["plain"] - 1200) < 120 and abs(forms["spm"] - 200) < 60
