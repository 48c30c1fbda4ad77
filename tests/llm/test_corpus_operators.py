"""Each operator on awkward rows: nulls, empty and long texts, ties, repeats, clashing columns, empty tables."""

import collections
import textwrap
import zlib

import brute
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest

from kontor.llm import binary_packing, exact_dedup, language_id, license_scan, mixing, mixture_packing, near_dedup, quality_rules, token_counts
from kontor.llm.common import fresh_path
from kontor.llm.tokens import encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
COLUMNS = "doc_id long, text string, lang string, source string, n_tokens string, kept string, size string, digest string"
LONG = " ".join(f"word{k}" for k in range(9000))
SENTENCE = "the quick brown fox jumps over the lazy dog and then it sleeps for a very long while under the old oak tree near us"


def table(spark, rows):
    """(doc_id, text, lang, source) rows with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", "y", "z", "d") for r in rows], COLUMNS)


@pytest.fixture(scope="module")
def rows():
    return [
        (1, SENTENCE, "en", "a"), (1, SENTENCE, "en", "a"), (2, SENTENCE + " x", "en", "b"), (3, None, None, None), (4, "", "en", "b"),
        (5, " \n\t ", "de", None), (6, LONG, "en", "a"), (7, "a b", None, "c"), (8, SENTENCE.upper(), "en", "c"), (9, SENTENCE.replace(" ", "\n"), "en", "b"),
        (10, "ein zwei <|endoftext|> drei", "de", "c"), (11, "x\nx\nx\ny\n\n" + SENTENCE, "en", "a"), (None, SENTENCE, "en", "b"), (12, "1 2 3 !!", "en", "b")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [(1, "", "", "")]).limit(0)


def full_ids(text):
    return encoder(PATH).tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def test_binary_packing_round_trip(docs, rows, empty):
    packed = binary_packing.packed_matrices(docs, PATH, window=256).collect()
    parts = collections.defaultdict(list)
    for r in packed:
        ids = np.frombuffer(bytes(r.ids), "<u2")
        assert len(ids) == 256 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and not ids[r.n_tokens:].any()
        assert r.position_resets == r.cu_seqlens[:-1]
        for key, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            parts[key].append((start, ids[a:b].tolist()))
    wanted = collections.Counter((key, tuple(x)) for key, text, *_ in rows for s, x in
                                 [(s, full_ids(text)[s:s + 256]) for s in range(0, len(full_ids(text)), 256)])
    assert collections.Counter((key, tuple(x)) for key, ps in parts.items() for _, x in ps) == wanted
    assert len({r.sequence_id for r in packed}) == len(packed)
    assert binary_packing.packed_matrices(empty, PATH).count() == 0


def test_best_fit_decreasing_matches_a_scan():
    random = np.random.default_rng(3)
    for _ in range(30):
        lengths = random.integers(1, 33, size=40)
        bins, free = [], []
        for k in np.argsort(-lengths, kind="stable").tolist():
            fits = [(f, b) for b, f in enumerate(free) if f >= lengths[k]]
            if not fits:
                bins.append([])
                free.append(32)
                fits = [(32, len(bins) - 1)]
            best = min(fits)[1]
            bins[best].append(k)
            free[best] -= lengths[k]
        mine = binary_packing.best_fit_decreasing(lengths, 32)
        assert sorted(sum(mine, [])) == list(range(40)) and len(mine) == len(bins)
        assert all(lengths[b].sum() <= 32 for b in mine)


def test_token_counts_and_cache(spark, docs, rows, empty, monkeypatch):
    cache = fresh_path(spark, "cache")
    got = token_counts.token_counts(docs, cache, PATH, over=100).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == collections.Counter(
        (key, len((text or "").encode()), len(full_ids(text)) - 1, len(full_ids(text)) > 101) for key, text, *_ in rows)
    held = spark.read.parquet(cache)
    first = held.count()
    assert first == held.select("content").distinct().count() < len(rows)
    more = table(spark, [(20, "new text", "en", "a"), (21, SENTENCE, "en", "a")])
    assert token_counts.token_counts(more, cache, PATH).count() == 2
    assert spark.read.parquet(cache).count() == first + 1  # only the miss was encoded and appended
    monkeypatch.setattr(token_counts, "tokenizer_version", lambda path: "another")
    assert token_counts.token_counts(more, cache, PATH).count() == 2
    assert spark.read.parquet(cache).count() == first + 3  # another version shares no counts
    assert token_counts.token_counts(empty, fresh_path(spark, "cache"), PATH).count() == 0


def test_quality_counts(spark, docs, rows, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1), (6, 7)], "doc_id long, quality int")
    got = quality_rules.quality_verdicts(docs, labels).collect()
    assert collections.Counter((r.doc_id, *[r[c] for c in quality_rules.COUNTS], r.base_failed) for r in got) == collections.Counter(
        (key, *brute.base_counts(text)) for key, text, *_ in rows)
    assert all(r.kept == (not r.base_failed) for r in got)  # too few labels certify nothing
    kept = quality_rules.accepted(docs, labels)
    assert kept.columns == docs.columns
    assert collections.Counter((r.doc_id, r.text) for r in kept.collect()) == collections.Counter(
        (key, text) for key, text, *_ in rows if not brute.base_counts(text)[-1])
    assert quality_rules.quality_verdicts(empty, labels).count() == 0
    assert quality_rules.quality_verdicts(docs, labels.limit(0)).count() == len(rows)


def test_repeated_words_against_brute():
    random = np.random.default_rng(5)
    texts = [" ".join(random.choice(["a", "b"], size=n)) for n in (0, 5, 8, 9, 20, 40, 80)] + ["z " * 30, ""]
    got = quality_rules.measures(pa.array(texts, pa.large_string()))["n_repeat_words"].tolist()
    assert got == [brute.base_counts(t)[4] for t in texts]


def test_binomial_bound_and_choice():
    from math import comb

    for n, k, p in ((10, 3, 0.2), (50, 0, 0.01), (7, 7, 0.5)):
        assert abs(quality_rules.binomial_tail(k, n, p) - sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))) < 1e-12
    good, bad = np.array([0, 0, 5, 400]), np.array([10, 30, 40, 500])
    assert quality_rules.choose_cutoff(good, bad, 1000, 0.02, 0.001, 1.0) == 2
    assert quality_rules.choose_cutoff(good, bad, 1000, 0.02, 0.001, 10.0) == 1
    assert quality_rules.choose_cutoff(good, bad, 50, 0.02, 0.001, 1.0) == -1


def test_false_rejection_stays_below_the_risk(spark):
    """Cutoffs fitted on one draw, measured on another of the same kind."""
    random = np.random.default_rng(11)

    def draw(n):
        data = {"doc_id": np.arange(n), "stratum": np.where(random.random(n) < 0.5, "s", None), "n_words": 100, "n_repeat_words": 0}
        good = random.random(n) < 0.8
        data |= {r: np.where(good, random.beta(1, 60, n), random.beta(2, 3, n)) for r in quality_rules.RULES}
        return pd.DataFrame(data), good

    fit, good = draw(8000)
    labels = spark.createDataFrame(pd.DataFrame({"doc_id": fit["doc_id"], "quality": good.astype(int)}))
    schema = "doc_id long, stratum string, n_words long, n_repeat_words long, " + ", ".join(f"{r} double" for r in quality_rules.RULES)
    cutoffs = quality_rules.fitted_cutoffs(spark.createDataFrame(fit, schema), labels)
    fresh, good = draw(8000)
    kept = quality_rules.judged(spark.createDataFrame(fresh, schema), cutoffs).select("doc_id", "stratum", "kept").toPandas().sort_values("doc_id")
    for stratum in ("s", None):
        mine = (fresh["stratum"] == stratum) if stratum else fresh["stratum"].isna()
        lost = ~kept["kept"].to_numpy() & mine.to_numpy()
        assert lost[good].sum() <= 0.03 * good[mine].sum()
        assert lost[~good].sum() > 0.5 * (~good & mine).sum()


def test_mixing(docs, rows, empty):
    plan = mixing.mixing_plan(docs).collect()
    want = brute.mixed([(k, t, s) for k, t, _, s in rows])
    assert collections.Counter((r.doc_id, r.size, r.taken) for r in plan) == collections.Counter(
        (k, len(brute.words(t)), sum(c)) for k, t, _, c in want)
    assert all(0 <= c.position <= 1 for r in plan for c in r.copies) and all(r.taken <= 3 * r.size for r in plan)
    mixed = mixing.mixture(docs)
    assert mixed.columns == docs.columns
    got = collections.Counter((r.doc_id, " ".join(brute.words(r.text))) for r in mixed.collect())
    assert got == collections.Counter((k, " ".join(brute.words(t)[:n])) for k, t, _, c in want for n in c)
    assert mixing.mixing_plan(empty).count() == 0 and mixing.mixture(empty).count() == 0


def test_curriculum_inverts_its_integral(spark):
    from pyspark.sql import functions as F

    grid = spark.range(0, 101).select((F.col("id") / 100).alias("share"))
    for w0, w1 in ((1.0, 1.0), (1.5, 0.5), (0.5, 1.5), (0.0, 2.0)):
        for r in grid.withColumn("t", mixing.training_time(F.col("share"), F.lit(w0), F.lit(w1))).collect():
            assert abs((w0 * r.t + (w1 - w0) * r.t * r.t / 2) / ((w0 + w1) / 2) - r.share) < 1e-9


@pytest.mark.parametrize("weights", [None, {"a": 1.0, "b": 4.0}])
def test_mixture_packing(docs, rows, empty, weights):
    pieces = mixture_packing.mixture_packed(docs, PATH, weights, window=64, quantum=16).collect()
    whole = collections.defaultdict(list)
    for key, text, *_ in rows:
        whole[key].append(full_ids(text))
    sequences, seen = collections.defaultdict(list), collections.Counter()
    for r in pieces:
        sequences[r.sequence_id].append((r.offset, r.length))
        fits = [x for x in whole[r.doc_id] if len(x) == r.doc_tokens]
        assert zlib.crc32(np.array(fits[0][r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        seen[r.doc_id] += r.length
    assert seen == collections.Counter({k: sum(map(len, v)) for k, v in whole.items()})
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at == 64 or (at < 64 and at & (at - 1) == 0)
    assert mixture_packing.mixture_packed(empty, PATH).count() == 0


def test_every_window_has_the_mixture():
    totals = [100_000, 30_000, 7_000, 0, 64_000]
    plan = mixture_packing.Schedule(totals, [t / sum(totals) or 1e-9 for t in totals], 4096, 256)
    source, begin, size = [], [], []
    for k, total in enumerate(totals):
        at = 0
        while at < total:
            n = min(777, total - at)
            source.append(k), begin.append(at), size.append(n)
            at += n
    row, start, length, sequence, offset = mixture_packing.document_pieces(plan, *map(np.array, (source, begin, size)))
    assert length.sum() == sum(totals)
    share = np.zeros((sequence.max() + 1, len(totals)))
    np.add.at(share, (sequence, np.array(source)[row]), length)
    full = share[: sum(totals) // 4096]
    assert (full.sum(axis=1) == 4096).all()
    goal = 4096 * np.array(totals) / sum(totals)
    assert np.abs(full - goal).max() <= 3 * 256
    assert np.abs(np.cumsum(full - goal, axis=0)).max() <= 3 * 256  # deficits do not add up


def test_language(spark, empty):
    letters = {"x": "abc", "y": "cde", "z": "éfg"}
    random = np.random.default_rng(2)
    text = lambda lang: " ".join("".join(random.choice(list(letters[lang]), size=4)) for _ in range(12))
    rows = [(k, text(lang), lang, "s") for k, lang in enumerate(list("xyz") * 30)]
    rows += [(200, None, "x", "s"), (201, "12 !?", "x", "s"), (202, text("x") * 3000, None, None), (None, text("y"), "y", "s"), (203, "", "z", "s")]
    docs = table(spark, rows)
    model = language_id.trained(docs.filter(~language_id.held_out()))
    assert model.languages == ["x", "y", "z"]
    got = {r.doc_id: r for r in language_id.predicted(docs, model).collect()}
    assert all(got[k].lang_pred == lang for k, t, lang, _ in rows[:90])
    assert [got[k].lang_pred for k in (200, 201, 203, 202, None)] == ["und", "und", "und", "x", "y"] and got[200].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    nothing = language_id.trained(empty)
    assert {r.lang_pred for r in language_id.predicted(docs, nothing).collect()} == {"und"}
    assert language_id.predicted(empty, model).count() == 0


def test_every_language_with_enough_rows_is_learned(spark):
    random = np.random.default_rng(6)
    text = lambda k: " ".join("".join(chr(0x4E00 + 4 * k + c) for c in random.integers(0, 4, 4)) for _ in range(12))
    rows = [(1000 * k + j, text(k), f"l{k:03d}", "s") for k in range(260) for j in range(language_id.LEAST_ROWS + (k < 256))]
    docs = table(spark, rows)
    model = language_id.trained(docs)
    assert len(model.languages) == 260
    last = docs.filter("lang >= 'l256'")
    assert {(r.doc_id // 1000, r.lang_pred) for r in language_id.predicted(last, model).collect()} == {(k, f"l{k}") for k in range(256, 260)}


def test_kernel_is_folded_exactly():
    texts = pa.array(["hello world", "hallo welt", "bonjour monde", "salut le monde", "hello there"], pa.large_string())
    have = language_id.presence(texts)
    model = language_id.fit([np.packbits(x).tobytes() for x in have], ["en", "de", "fr", "fr", "en"], landmarks=5)
    unit = have / np.sqrt(have.sum(axis=1, keepdims=True))
    assert [model.languages[k] for k in (unit @ model.weights + model.bias).argmax(axis=1)] == ["en", "de", "fr", "fr", "en"]
    long = "ab" * language_id.STEP_CHARS
    assert (language_id.presence(pa.array([long], pa.large_string())) == language_id.presence(pa.array(["ab" * 9], pa.large_string()))).all()


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, docs, rows, empty, width, percent):
    got = near_dedup.near_duplicates(docs, width, percent).collect()
    real = [(k, t) for k, t, *_ in rows if k is not None]
    want = brute.components(real, width, percent)
    assert {r.doc_id: r.component_id for r in got if r.doc_id} == want
    assert all(r.n_shingles == len(brute.shingles(t, width)) for r in got for k, t in real if k == r.doc_id)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(1, False)]
    left = near_dedup.representatives(docs, width, percent)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(k for k, _ in real if want[k] == k)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_rows_without_an_id_are_removed_by_their_text(spark):
    unique = " ".join(f"only{k}" for k in range(30))
    rows = [(1, SENTENCE, "en", "a"), (None, SENTENCE, "en", "b"), (None, unique, "en", "c"), (None, None, "en", "d"), (None, "short", "en", "e"), (2, SENTENCE, "en", "f")]
    left = near_dedup.representatives(table(spark, rows)).collect()
    assert sorted(r.source for r in left) == ["a", "c", "d", "e"]


def test_large_groups_of_near_copies(spark, monkeypatch):
    """A star: copies are like the original, but hardly like each other; and a chain. No node size loses a link."""
    monkeypatch.setattr(near_dedup, "SMALL", 4)
    random = np.random.default_rng(7)
    base = [f"w{k}" for k in range(300)]
    texts = [" ".join(base)]
    for k in range(60):
        own = list(base)
        for at in random.choice(300, size=9, replace=False):
            own[at] = f"n{k}_{at}"
        texts.append(" ".join(own))
    chain = [f"c{k}" for k in range(300)]
    for k in range(0, 120, 12):
        texts.append(" ".join(chain[k:k + 180]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, 3, 80).collect()}
    assert got == brute.components(list(enumerate(texts)), 3, 80)


def test_word_hashes_do_not_depend_on_the_batch():
    texts = pa.array(["A  b\tc", "", "b c d é", " b "], pa.large_string())
    flat, offsets = near_dedup.word_hashes(texts)
    alone = [near_dedup.word_hashes(texts.slice(k, 1))[0].tolist() for k in range(4)]
    assert [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == alone
    assert flat[1] == flat[3] and len(set(flat.tolist())) == 5


def test_licences(spark, docs, rows, empty):
    wording = dict((n, w) for n, w in reversed(license_scan.TEMPLATES))
    changed = wording["ISC"].replace("fee", "charge")
    more = [(50, "prose here\nReleased under the MIT license\nmore", "en", "a"), (51, changed, "en", "a"), (52, "\n\n".join([SENTENCE, wording["ISC"].replace(". ", ".\n"), SENTENCE]), "en", "a"),
            (53, "This is free of charge and published without a license", "en", "a"), (53, None, "en", "a")]
    got = {(r.doc_id, r.license): r for r in license_scan.scanned(docs.unionByName(table(spark, more))).collect()}
    assert {k for k in got if k[1]} == {(50, "MIT"), (51, "ISC"), (52, "ISC")}
    assert got[(50, "MIT")].dice == 1.0 and 0.85 <= got[(51, "ISC")].dice < 1.0
    assert license_scan.scanned(empty).count() == 0


def test_licences_over_several_lines_and_paragraphs(spark):
    wording = dict((n, w) for n, w in reversed(license_scan.TEMPLATES))
    prose = "\n".join(" ".join(f"word{k * 12 + j}" for j in range(12)) for k in range(60))

    def wrapped(text, width, every):
        """Lines of ``width`` characters, with a blank line behind every few of them."""
        lines = textwrap.wrap(text, width)
        return "\n\n".join("\n".join(lines[k:k + every]) for k in range(0, len(lines), every))

    header = "\n".join("// " + line for line in textwrap.wrap([w for n, w in license_scan.TEMPLATES if n == "Apache-2.0"][1], 70))
    more = [(60, f"{prose}\n\n{wrapped(wording['MIT'], 72, 5)}\n\n{prose}"), (61, f"{prose}\n\n{wrapped(wording['BSD-2-Clause'], 78, 4)}\n\n{prose}"),
            (62, f"{prose}\n\n{wrapped(wording['BSD-3-Clause'], 60, 3)}\n \n{prose}"), (63, f"#!/bin/sh\n{header}\nimport os\nimport sys\n{prose}"),
            (64, "my project\nReleased under\nthe MIT License.\nmore text here"), (65, f"{prose}\nReleased under the MIT License.\nok\n{prose}"),
            (66, f"{prose}\n{wrapped(wording['MIT'], 72, 5)}\n{prose}\n{wrapped(wording['BSD-2-Clause'], 72, 5)}"), (67, f"{prose}\n\n{wording['MIT'][:300]}\n\n{prose}")]
    got = {r.doc_id: r for r in license_scan.scanned(spark.createDataFrame(more, "doc_id long, text string")).collect()}
    assert {k: (r.license, r.n_matches) for k, r in got.items()} == {
        60: ("MIT", 1), 61: ("BSD-2-Clause", 1), 62: ("BSD-3-Clause", 1), 63: ("Apache-2.0", 1), 64: ("MIT", 1), 65: ("MIT", 1), 66: ("BSD-2-Clause", 2), 67: (None, 0)}
    assert all(got[k].dice == 1.0 for k in (60, 61, 62, 63, 64, 65, 66))


def test_exact_groups(spark, docs, rows, empty):
    want = brute.exact_keep([(k, t) for k, t, *_ in rows])
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.keep_id, r.group_size) == want[r.text_sha256] and r.kept == (r.doc_id == r.keep_id)
    left = exact_dedup.deduplicated(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(k for k, _ in want.values())
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.deduplicated(empty).count() == 0
    # a history: members are repeats, nonmembers are grouped among themselves
    history = table(spark, [(100, SENTENCE, "en", "a"), (101, "old", "en", "a")])
    got = {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.exact_groups(docs, history).collect() if r.doc_id in (1, 2, 7)}
    assert got == {(1, 100, False), (2, 2, True), (7, 7, True)}


def test_perfect_hash():
    random = np.random.default_rng(1)
    for n in (1, 2, 65, 3000):
        keys = random.integers(0, 256, size=(n, 32), dtype=np.uint8)
        levels, slots = exact_dedup.perfect_hash(keys)
        assert sorted(slots.tolist()) == list(range(n)) and (exact_dedup.slots_of(levels, keys) == slots).all()
        others = random.integers(0, 256, size=(500, 32), dtype=np.uint8)
        assert (exact_dedup.slots_of(levels, others) < n).all()
    with pytest.raises(ValueError):
        exact_dedup.perfect_hash(np.zeros((2, 32), np.uint8))
