"""Queries over the driver tables, one for each corpus operator, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kontor.llm.binary_packing import packed_matrices
from kontor.llm.byte_bpe import round_trip
from kontor.llm.common import SPACE, fresh_path, text_of
from kontor.llm.exact_dedup import exact_groups
from kontor.llm.fill_middle import MIDDLE, PREFIX, SEED, SUFFIX, examples, restored
from kontor.llm.language_id import held_out, predicted, trained
from kontor.llm.license_scan import LEAST_DICE, TEMPLATES, scanned
from kontor.llm.mixing import mixing_plan
from kontor.llm.mixture_packing import mixture_packed
from kontor.llm.near_dedup import near_duplicates
from kontor.llm.pii import found_spans
from kontor.llm.quality_rules import COUNTS, quality_verdicts
from kontor.llm.token_counts import token_counts
from kontor.llm.word_runs import LEAST_EXPONENT, LEAST_LENGTH, word_runs

WORD_BPE = "word_bpe_49k.json"
BYTE_RANKS = "byte_bpe_50k.tiktoken"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_matrices(documents(spark, sf_dir), public_tokenizers.path(WORD_BPE))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts with an empty cache of its own, so every distinct text is a miss once."""
    return token_counts(documents(spark, sf_dir), fresh_path(spark, "token-cache"), public_tokenizers.path(WORD_BPE))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality_verdicts(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return verdicts.select("doc_id", *COUNTS, "base_failed", "kept")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing_plan(documents(spark, sf_dir))
    first = F.try_element_at("copies", F.lit(1))["position"]
    return plan.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken", F.round(first, 6).alias("position"))


def op5_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_packed(documents(spark, sf_dir), public_tokenizers.path(WORD_BPE))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = trained(docs.filter(~held_out()))
    return predicted(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract of this query asks for three words and a similarity of 0.85."""
    return near_duplicates(documents(spark, sf_dir), width=3, percent=85)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_spans(documents(spark, sf_dir))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scanned(documents(spark, sf_dir))
    return found.withColumn("dice", F.round("dice", 6))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


def planted(docs: DataFrame) -> DataFrame:
    """One document in ten, chosen by the checksum of its id, becomes periodic from a word on, as the contract of op11 asks."""
    checksum = F.crc32(F.col("doc_id").cast("string"))
    g, n = F.floor(checksum / 10), F.size("words")
    split = F.filter(F.split(text_of(), SPACE + "+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.when(checksum % 10 == 0, split).alias("words"))
    rows = rows.withColumn("a", F.when(n > 0, g % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    moved = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(
        F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return rows.select("doc_id", F.when(n > 0, F.array_join(moved, " ")).otherwise(F.col("text")).alias("text"))


def run_rows(docs: DataFrame) -> DataFrame:
    """Counts, the longest run and digests of all runs and of the collapsed text."""
    ranked = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    found = word_runs(docs).withColumn("best", F.array_max(ranked))
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_rows(planted(documents(spark, sf_dir)))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), public_tokenizers.path(BYTE_RANKS))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = examples(documents(spark, sf_dir))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_binary_packing, op2_token_counts, op3_quality_rules, op4_mixing, op5_mixture_packing, op6_language_id, op7_near_dedup, op8_pii, op9_license_scan, op10_exact_dedup,
    op11_word_runs, op12_byte_bpe, op13_fill_middle)}

_SIZE = r"CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT)"
_BIGRAMS = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
_TEMPLATE_ROWS = ", ".join("('{}', '{}')".format(name, wording.replace("'", "''")) for name, wording in TEMPLATES)
_WORDS_OF = "string_split(trim(regexp_replace({}, '[^a-z0-9]+', ' ', 'g')), ' ')"

SQL: dict[str, str] = {
    "op4_mixing": f"""
        WITH sized AS (
          SELECT doc_id, source, {_SIZE} AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || md5(coalesce(text, ''))) AS place, md5(coalesce(text, '')) AS digest
          FROM documents),
        totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number
                   FROM sized GROUP BY source),
        weighed AS (SELECT *, 1.0::DOUBLE + number % 3 AS weight, 3.0::DOUBLE * source_size AS cap,
                           [1.0, 1.5, 0.5][number % 3 + 1]::DOUBLE AS w0, [1.0, 0.5, 1.5][number % 3 + 1]::DOUBLE AS w1 FROM totals),
        levels AS (SELECT a.*, (SELECT sum(source_size) FROM weighed) AS everything,
                     (SELECT coalesce(sum(b.cap), 0) FROM weighed b WHERE b.cap / b.weight < a.cap / a.weight
                        OR (b.cap / b.weight = a.cap / a.weight AND b.number < a.number)) AS fixed,
                     (SELECT sum(b.weight) FROM weighed b WHERE b.cap / b.weight > a.cap / a.weight
                        OR (b.cap / b.weight = a.cap / a.weight AND b.number >= a.number)) AS open FROM weighed a),
        levelled AS (SELECT *, (everything - fixed) / open AS level FROM levels),
        free AS (SELECT arg_min(level, cap / weight) AS free FROM levelled WHERE cap >= level * weight),
        targets AS (SELECT source, source_size, coalesce(least(cap, free * weight), cap) AS target, w0, w1 FROM levelled, free),
        queued AS (SELECT s.*, t.source_size, t.target, t.w0, t.w1,
                     coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY place, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
                   FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
        taken AS (SELECT *, greatest(least(size, CAST(round(target) AS BIGINT) - before), 0) AS a,
                    greatest(least(size, CAST(round(target) AS BIGINT) - before - source_size), 0) AS b,
                    greatest(least(size, CAST(round(target) AS BIGINT) - before - 2 * source_size), 0) AS c,
                    before / greatest(target, 1.0) AS share, (w1 - w0) / (w0 + w1) AS p, 2.0 * w0 / (w0 + w1) AS q FROM queued)
        SELECT doc_id, size, source_size, round(target, 3) AS target, CAST(a + b + c AS BIGINT) AS taken,
               CASE WHEN a > 0 THEN round(least(2.0 * share / (q + sqrt(greatest(q * q + 4.0 * p * share, 0.0))), 1.0), 6) END AS position
        FROM taken""",
    "op9_license_scan": f"""
        WITH wordings(name, wording) AS (VALUES {_TEMPLATE_ROWS}),
        template_words AS (SELECT name, {_WORDS_OF.format("lower(wording)")} AS w FROM wordings),
        templates AS (SELECT name, {_BIGRAMS.format("w")} AS t FROM template_words),
        low AS (SELECT doc_id, lower(coalesce(text, '')) AS l FROM documents),
        part AS (SELECT DISTINCT doc_id, {_WORDS_OF.format("p")} AS w FROM (SELECT doc_id, unnest(list_concat(
                   string_split(l, chr(10)), string_split_regex(l, '\\n[ \\t\\r]*\\n'), [l])) AS p FROM low)),
        own AS (SELECT doc_id, w, {_BIGRAMS.format("w")} AS b FROM part WHERE len(w) > 1),
        dice AS (SELECT doc_id, w, name, 2.0::DOUBLE * len(list_intersect(b, t)) / (len(b) + len(t)) AS dice FROM own, templates
                 WHERE len(t) * {LEAST_DICE} <= len(b) * {2 - LEAST_DICE} AND len(b) * {LEAST_DICE} <= len(t) * {2 - LEAST_DICE}),
        best AS (SELECT doc_id, name AS license, dice, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, name) AS r,
                   count(w) OVER (PARTITION BY doc_id) AS parts FROM
                 (SELECT doc_id, w, name, dice FROM dice WHERE dice >= {LEAST_DICE}
                  QUALIFY row_number() OVER (PARTITION BY doc_id, w ORDER BY dice DESC, name) = 1))
        SELECT d.doc_id, license, round(dice, 6) AS dice, coalesce(parts, 0) AS n_matches
        FROM documents d LEFT JOIN best b ON d.doc_id = b.doc_id AND r = 1""",
    "op11_word_runs": f"""
        WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
                       lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
        docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
                   xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
                     lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM documents, crc),
        placed AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM docs),
        words AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i:
                    CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) + 1] END) END AS w FROM placed),
        each AS (SELECT r, n, unnest(w) AS w, unnest(range(n)) AS i FROM words),
        threes AS (SELECT r, n, i, w || ' ' || lead(w) OVER d || ' ' || lead(w, 2) OVER d AS t FROM each WINDOW d AS (PARTITION BY r ORDER BY i)),
        apart AS (SELECT x.r, x.i, y.i - x.i AS q FROM threes x JOIN threes y ON x.r = y.r AND x.t = y.t
                  WHERE y.i > x.i AND {LEAST_EXPONENT} * (y.i - x.i) <= x.n),
        islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM apart),
        stretches AS (SELECT r, q, min(i) AS start, count(*) + 2 + q AS length FROM islands GROUP BY r, q, island
                      HAVING count(*) + 2 + q >= greatest({LEAST_LENGTH}, {LEAST_EXPONENT} * q)),
        runs AS (SELECT r, start, length, min(q) AS period FROM stretches GROUP BY r, start, length),
        listed AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
                   FROM runs GROUP BY r),
        best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY length DESC, start, period) = 1),
        kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS collapsed FROM each e
                 WHERE NOT EXISTS (SELECT 1 FROM runs u WHERE u.r = e.r AND e.i >= u.start + u.period AND e.i < u.start + u.length) GROUP BY r)
        SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli,
               sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
        FROM words d LEFT JOIN listed l ON d.r = l.r LEFT JOIN best b ON d.r = b.r LEFT JOIN kept k ON d.r = k.r""",
    "op13_fill_middle": f"""
        WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        numbers AS (SELECT *, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS units, CAST('0x' || h[1:8] AS BIGINT) AS h1,
                      CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM docs),
        cuts AS (SELECT *, CAST(len(units) AS BIGINT) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a,
                   greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b FROM numbers),
        parts AS (SELECT doc_id, text, n, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m,
                    array_to_string(units[b + 1:n], '') AS s,
                    CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') THEN 'plain'
                         WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM cuts)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m
                      ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
               sha256(CASE form WHEN 'plain' THEN text ELSE p || m || s END) AS restored_sha256
        FROM parts""",
    "op10_exact_dedup": r"""
        WITH rows AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                             sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept, text_sha256
        FROM rows WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)""",
}
