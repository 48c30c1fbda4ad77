"""Ids against the encoding library itself, and exact round trips."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from kontor.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = [
    "", "a", " ", "aaaaaaa" * 50, " \n\t x", "<|endoftext|>", "日本語テキスト", "ab" * 3000, "x" * 300 + "y" * 400, "don't we'll 'S", "  two  spaces \n\n",
    "\x1c\x85᠎​", "՘ab꟎12\U00011de0 1\U00011de0!՘", "\U0001F600 é́", "\x00"]


def same(texts):
    coder = byte_bpe.vocabulary(PATH, public_tokenizers.PATTERN)
    flat, edges = coder.encoded(pa.array(texts, pa.large_string()))
    for text, start, stop in zip(texts, edges, edges[1:]):
        assert flat[start:stop].tolist() == LIBRARY.encode_ordinary(text)
        assert coder.decoded(flat[start:stop]).tobytes() == text.encode()


def test_odd_texts():
    same(ODD)
    for text in ODD:
        same([text])
    same([])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abe 's\n9é"), st.characters(blacklist_categories=["Cs"])), max_size=60), max_size=5))
def test_any_texts(texts):
    same(texts)


def test_every_way_of_merging(monkeypatch):
    """Buckets merged at once and place by place give the same ids, with overlapping equal pairs."""
    rng = random.Random(5)
    pieces = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 400))) for letters in ("ab", "a", "the rin", "日本é") for _ in range(60)]
    for few in (1, 12, 10**9):
        monkeypatch.setattr(byte_bpe, "FEW", few)
        coder = byte_bpe.RankVocabulary(PATH, public_tokenizers.PATTERN)
        for piece in pieces:
            word = piece.replace(" ", "")
            ids, sizes = coder.merged([word.encode()])
            assert ids.tolist() == LIBRARY._core_bpe.encode_single_piece(word.encode()) and sizes.tolist() == [len(ids)]


def test_long_piece():
    rng = random.Random(3)
    for text in ("".join(rng.choice("abcdefgh") for _ in range(60_000)), "a" * 100_000):
        same([text])


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMORY", 50)
    monkeypatch.setattr(byte_bpe, "BLOCK", 20)
    coder = byte_bpe.RankVocabulary(PATH, public_tokenizers.PATTERN)
    for k in range(20):
        texts = [f"wordq{chr(97 + k)}{chr(97 + j)}zz otherq{j}" for j in range(20)]
        flat, edges = coder.encoded(pa.array(texts, pa.large_string()))
        assert [flat[a:b].tolist() for a, b in zip(edges, edges[1:])] == [LIBRARY.encode_ordinary(x) for x in texts]
        assert len(coder.known) <= 100


def test_bitmap_finds_least():
    queue, rng = byte_bpe.RankQueue(300_000), random.Random(1)
    ranks = [rng.randrange(300_000) for _ in range(500)]
    queue.push(np.array(ranks), np.arange(500))
    taken = []
    while (rank := queue.least()) >= 0:
        taken.extend([rank] * len(queue.take(rank)))
    assert taken == sorted(ranks)


def test_documents(spark):
    texts = [*ODD, None, "twice", "twice", "long " * 100_000]
    rows = [(k if k else None, x, "keep", "old") for k, x in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, ids string").repartition(3)
    found = byte_bpe.encoded(docs, PATH)
    assert found.columns == ["doc_id", "source", "ids", "n_tokens"]
    for row in found.collect():
        want = LIBRARY.encode_ordinary(texts[row.doc_id or 0] or "")
        assert row.n_tokens == len(want) and np.frombuffer(row.ids, "<u4").tolist() == want and row.source == "keep"
    for row in byte_bpe.round_trip(docs, PATH).collect():
        text = texts[row.doc_id or 0] or ""
        ids = np.array(LIBRARY.encode_ordinary(text), "<u4")
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest() and row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert byte_bpe.round_trip(docs.limit(0), PATH).collect() == []
