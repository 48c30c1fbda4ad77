"""Language identification by a string kernel.

The kernel of two texts is the number of character n-grams present in both (n = 1..4, blended), divided by the root of
the product of their n-gram counts; n-grams are hashed to a fixed number of buckets. A bounded, labelled sample gives
Nyström landmarks, on whose kernel map a one-versus-rest ridge regression is solved. Because the kernel is an inner
product of presence vectors, landmarks and regression fold into one weight per bucket and language, and a batch of
texts is scored by one matrix product.

Null texts and texts without a letter are ``und`` with score 0. Null languages are not learned from. Ties go to the
language first in order. Without any usable label every text is ``und``. Repeated rows are predicted each on its own.
Only named columns are read, so others cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kontor.llm.common import column, slices

ORDERS = (1, 2, 3, 4)
BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
#: Labelled rows learned from, landmarks among them, languages (those with most rows) that are learned from fewer rows, too, rows per language.
TRAIN_ROWS, LANDMARKS, LANGUAGES, LEAST_ROWS = 4096, 512, 256, 16
RIDGE = 1e-3
#: Parts in which the rows of one language are ranked first.
RANK_PARTS = 256
#: Characters of text that are turned into n-grams at once.
STEP_CHARS = 1 << 18
#: Row bound of one presence matrix.
STEP_TEXTS = 128


def _letter_runs(texts: pa.Array) -> pa.Array:
    """Lower-case texts with everything but letters and their marks made one space, and a space at both ends."""
    spaced = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\pL\pM]+", " ")
    spaced = pc.if_else(pc.match_substring_regex(texts, r"\pL"), spaced, "")  # marks without any letter are no language
    none, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    return pc.binary_join_element_wise(none, pc.utf8_trim(spaced, " "), none, space)


def presence(texts: pa.Array) -> np.ndarray:
    """Boolean matrix: which n-gram buckets each text has. A text of any length is gone through in pieces."""
    runs = _letter_runs(texts)
    _, where, data = runs.buffers()
    edges = np.frombuffer(where, np.int64)[runs.offset:runs.offset + len(runs) + 1]
    out = np.zeros((len(texts), BUCKETS), bool)
    flat = out.reshape(-1)
    held = np.frombuffer(data, np.uint8)
    for row, (begin, end) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
        if end - begin < 3:  # no letter between the two spaces
            continue
        for at in range(begin, end, STEP_CHARS):
            # pieces overlap by the longest n-gram's bytes, so none is cut
            piece = held[at:min(end, at + STEP_CHARS + 4 * max(ORDERS))]
            lead = np.flatnonzero((piece & 0xC0) != 0x80)
            code = piece.astype(np.uint32)
            point = code[lead]
            for k in (1, 2, 3):  # bytes of one character, folded to one number
                follow = lead + k
                inside = follow < len(piece)
                more = np.zeros(len(lead), np.uint32)
                more[inside] = code[follow[inside]]
                point = np.where((more & 0xC0) == 0x80, point * np.uint32(256) + more, point)
            hashed, base = np.zeros(len(point), np.uint32), row << BUCKET_BITS
            for order in ORDERS:
                n = len(point) - order + 1
                if n <= 0:
                    break
                hashed = (hashed[:n] ^ point[order - 1:]) * np.uint32(0x9E3779B1)
                hashed ^= hashed >> np.uint32(15)
                flat[base + ((hashed * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)] = True
    return out


class Model:
    """Languages, and one weight per bucket and language."""

    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray):
        self.languages, self.weights, self.bias = languages, weights, bias

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        for at in range(0, len(texts), STEP_TEXTS) if self.languages else ():
            have = presence(texts.slice(at, STEP_TEXTS))
            size = have.sum(axis=1)
            margins = have.astype(np.float32) @ self.weights / np.sqrt(np.maximum(size, 1))[:, None] + self.bias
            best = margins.argmax(axis=1)
            for k in np.flatnonzero(size):
                names[at + k] = self.languages[best[k]]
                scores[at + k] = min(1.0, max(0.0, (1.0 + float(margins[k, best[k]])) / 2.0))
        return names, scores


def fit(packed: list[bytes], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Nyström map of the kernel on landmarks taken in turn from the languages, then ridge regression per language."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    number = {x: k for k, x in enumerate(languages)}
    label = np.array([number[x] for x in labels])
    turn = np.zeros(len(label), np.int64)
    for k in range(len(languages)):
        turn[label == k] = np.arange((label == k).sum())
    chosen = np.sort(np.lexsort((label, turn))[:landmarks])

    def rows(of: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(np.frombuffer(b"".join(packed[i] for i in of), np.uint8)).reshape(len(of), BUCKETS).astype(np.float32)
        return bits / np.sqrt(np.maximum(bits.sum(axis=1, keepdims=True), 1))

    marks = rows(chosen)
    kernel = np.concatenate([rows(np.arange(at, min(at + 256, len(label)))) @ marks.T for at in range(0, len(label), 256)])
    value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    mapped = kernel @ root
    centre = mapped.mean(axis=0)
    mapped = mapped - centre
    target = np.where(label[:, None] == np.arange(len(languages)), 1.0, -1.0)
    offset = target.mean(axis=0)
    solved = np.linalg.solve(mapped.T @ mapped + ridge * len(label) * np.eye(mapped.shape[1]), mapped.T @ (target - offset))
    return Model(languages, (marks.T @ (root @ solved)).astype(np.float32), offset - centre @ solved)


def training_rows(docs: DataFrame, text: str, key: str, language: str, rows: int) -> DataFrame:
    """(language, packed presence) of the sample: per language the rows first by digest of their id, ``rows`` in all."""
    spark = docs.sparkSession
    known = docs.filter(F.col(language).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).cast("string").alias("id"), F.col(language).cast("string").alias("language"))
    counts = known.groupBy("language").count()
    # every language with enough rows, and up to LANGUAGES of any size
    common = set(counts.filter(F.col("count") >= LEAST_ROWS).collect()) | set(counts.orderBy(F.desc("count"), "language").limit(LANGUAGES).collect())
    names, count = sorted(r.language for r in common), len(common)
    each = max(LEAST_ROWS, rows // max(1, count))
    # digests are spread evenly, so the first ``each`` of a language lie below a share of their range that its count tells,
    # with room; a language of which too few do, as many rows bear few ids, is ranked whole, in parts first
    digest = F.md5(F.coalesce("id", F.lit("")).cast("binary"))
    lead = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    counted = {r.language: r["count"] for r in common}
    below = {x: min(1.0, (each + 6 * each ** 0.5 + 20) / n) for x, n in counted.items()}

    def cut(shares: dict[str, float]) -> DataFrame:
        limits = spark.createDataFrame([(x, int(share * 2 ** 32)) for x, share in shares.items()], "language string, below long")
        return known.join(F.broadcast(limits), "language").filter(lead < F.col("below")).drop("below")

    enough = {r.language for r in cut(below).groupBy("language").count().collect() if r["count"] >= min(each, counted[r.language])}
    ids = cut({x: share if x in enough else 1.0 for x, share in below.items()}).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(RANK_PARTS)))
    for keys in (["language", "part"], ["language"]):
        ids = ids.withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy(digest, "id"))).filter(F.col("n") <= each)
    # at most rows + LEAST_ROWS x languages ids: small by construction
    wanted = F.broadcast(ids.select(F.col("id").alias("__id"), F.col("language").alias("__language")).distinct())
    texts = docs.select(F.col(key).cast("string").alias("id"), F.col(language).cast("string").alias("language"), F.col(text).alias("text")).join(
        wanted, F.col("id").eqNullSafe(F.col("__id")) & (F.col("language") == F.col("__language")), "left_semi").filter(F.col("text").isNotNull())
    # an id that several rows bear stands for one of them, always the same
    texts = texts.groupBy("id", "language").agg(F.min_by("text", F.md5(F.col("text").cast("binary"))).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for at in range(0, batch.num_rows, STEP_TEXTS):
                part = batch.slice(at, STEP_TEXTS)
                have = np.packbits(presence(column(part, "text")), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("language"), pa.array([x.tobytes() for x in have], pa.binary())], ["id", "language", "bits"])

    return texts.mapInArrow(run, "id string, language string, bits binary")


def trained(docs: DataFrame, text: str = "text", key: str = "doc_id", language: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    """Fit on a bounded sample: at most ``rows + LEAST_ROWS * languages`` packed presence vectors (4 kB each) reach the driver."""
    sample = sorted(training_rows(docs, text, key, language, rows).collect(), key=lambda r: (r.language, r.id or "", bytes(r.bits)))
    return fit([bytes(r.bits) for r in sample], [r.language for r in sample])


def predicted(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    context = docs.sparkSession.sparkContext
    # buckets x languages weights; a language needs LEAST_ROWS labelled rows of the bounded sample to be there
    shared = context.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, scores = shared.value.predict(column(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, lang_pred string, score double")


def held_out(key: str = "doc_id"):
    """Documents never learned from: a fifth, by checksum of the id. A null id is held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(True))
