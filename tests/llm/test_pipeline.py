"""The pipeline against a plain Python version on the smallest table."""

import collections
import zlib

import brute
import numpy as np
import public_tokenizers

import corpus_pipeline
from kontor.llm.tokens import encoder

SF = "/root/testdata/sf0.001"


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality == 1}
    assert len(good) < 1000  # too few to certify a cutoff of any rule: the base rules decide
    kept = [r for r in docs if not brute.base_counts(r.text)[-1]]
    stay = {k for k, _ in brute.exact_keep([(r.doc_id, r.text) for r in kept]).values()}
    kept = [r for r in kept if r.doc_id in stay]
    owner = brute.components([(r.doc_id, r.text) for r in kept], 5, 80)
    kept = [r for r in kept if owner[r.doc_id] == r.doc_id]
    copies = [(k, " ".join(brute.words(t)[:n])) for k, t, _, c in brute.mixed([(r.doc_id, r.text, r.source) for r in kept]) for n in c]
    coder = encoder(public_tokenizers.path("word_bpe_49k.json")).tokenizer
    want = collections.Counter((k, tuple(coder.encode(t, add_special_tokens=False).ids + [2])) for k, t in copies)

    pieces = corpus_pipeline.run(spark, SF).collect()
    tokens = collections.Counter()
    texts = collections.defaultdict(set)
    for (key, ids), n in want.items():
        tokens[(key, len(ids))] += n * len(ids)
        texts[(key, len(ids))].add(ids)
    got, sequences = collections.Counter(), collections.defaultdict(list)
    for r in pieces:
        got[(r.doc_id, r.doc_tokens)] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
        assert any(zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for ids in texts[(r.doc_id, r.doc_tokens)])
    assert got == tokens
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at == 4096 or at & (at - 1) == 0


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
