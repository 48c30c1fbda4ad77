"""Prediction against the kernel itself, landmark by landmark, and the sample against a plain ranking."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kontor.llm import language_id

WORDS = {"en": "the of and to in is that it was for".split(), "de": "der die und das ist nicht ein zu von mit".split(), "fr": "le la et les des est que une dans pour".split()}


def sentence(rng, lang):
    return " ".join(rng.choice(WORDS[lang], 12))


def test_prediction_equals_kernel_rows():
    """Folded weights give what the landmarks' kernel rows, mapped and regressed one text at a time, give."""
    rng = np.random.default_rng(3)
    labels = [lang for lang in WORDS for _ in range(30)]
    train = [sentence(rng, lang) for lang in labels]
    have = language_id.presence(pa.array(train, pa.large_string()))
    model = language_id.fit([np.packbits(h).tobytes() for h in have], labels, landmarks=24)
    grams = [set(np.flatnonzero(h)) for h in have]
    kernel = lambda a, b: len(a & b) / np.sqrt(max(len(a), 1) * max(len(b), 1))
    names = sorted(WORDS)
    marks = [[k for k, x in enumerate(labels) if x == lang][turn] for turn in range(8) for lang in names]
    marks = sorted(marks)
    inner = np.array([[kernel(grams[a], grams[b]) for b in marks] for a in marks])
    value, vector = np.linalg.eigh(inner)
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    mapped = np.array([[kernel(g, grams[m]) for m in marks] for g in grams]) @ root
    centre = mapped.mean(axis=0)
    target = np.array([[1.0 if x == lang else -1.0 for lang in names] for x in labels])
    solved = np.linalg.solve((mapped - centre).T @ (mapped - centre) + language_id.RIDGE * len(labels) * np.eye(mapped.shape[1]),
                             (mapped - centre).T @ (target - target.mean(axis=0)))
    tests = [sentence(rng, lang) for lang in names for _ in range(20)]
    got, scores = model.predict(pa.array(tests, pa.large_string()))
    for text, name, score in zip(tests, got, scores):
        own = set(np.flatnonzero(language_id.presence(pa.array([text], pa.large_string()))[0]))
        margins = (np.array([kernel(own, grams[m]) for m in marks]) @ root - centre) @ solved + target.mean(axis=0)
        assert name == names[int(margins.argmax())]
        assert abs(score - min(1, max(0, (1 + margins.max()) / 2))) < 1e-4


def test_texts_without_letters():
    model = language_id.Model(["xx"], np.ones((language_id.BUCKETS, 1), np.float32), np.zeros(1))
    texts = ["", "12 3!", "́̈", " ⃝ ", "á"]
    assert model.predict(pa.array(texts, pa.large_string()))[0] == ["und"] * 4 + ["xx"]


def test_sample_is_ranked_in_parts(spark):
    """Rows that bear one id give one sample row, and the ids are the first by digest, however the rows are dealt."""
    rows = [(k % 900 or None, f"text {k} abc", "aa" if k % 3 else "bb") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    digest = lambda i: hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()
    found = None
    for parts in (1, 7, 40):
        sample = language_id.training_rows(docs.repartition(parts, F.rand(parts)), "text", "doc_id", "lang", 200).collect()
        assert len({(r.id, r.language) for r in sample}) == len(sample) <= 200
        now = sorted((r.language, r.id or "", bytes(r.bits)) for r in sample)
        assert found is None or found == now
        found = now
    for lang in ("aa", "bb"):
        ids = sorted((digest(i) for i, _, own in rows if own == lang))[:100]
        assert {digest(int(r[1]) if r[1] else None) for r in found if r[0] == lang} == set(ids)
