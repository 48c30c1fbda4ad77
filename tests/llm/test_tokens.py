"""Ids and counts against the library itself."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kontor.llm.tokens import encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "don't you'll we've they're I'm he'd it's", "'s's ''s !'s x'sy 'tt 're've 'R 'LL'l", "O'Reilly's \t\n don’t",
    "<|endoftext|> a <|ENDOFTEXT|>b<|startoftext|>", "ÀÉÎ straße ŒUVRE İstanbul ǅ Ⱥ", "Ελληνικά ΣΑΣ ΟΔΟΣ", "日本語 text", "áé",
    "x y z\x85w\x1cv", "1234 3.14 12a34", "tab\x0bvt\x0cff\rcr", "\x00\x01", "!!!??? *** ###word###", "a" * 5000, "\U0001F600 ok", "'", "''", "it'",
    "1's 2't", "×÷ ¼ ² ª º µ"]


def both(texts):
    coder = encoder(PATH)
    want = [x.ids for x in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    flat, offsets = coder.ids(pa.array(texts, pa.large_string()))
    got = [flat[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]
    assert got == want
    assert coder.counts(pa.array(texts, pa.large_string())).tolist() == [len(x) for x in want]


def test_odd_texts():
    both(ODD)
    for text in ODD:
        both([text])
    both([])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("'strevlmdSTA z\n9!é"), st.characters(blacklist_categories=["Cs"])), max_size=30), max_size=5))
def test_any_texts(texts):
    both(texts)


def test_memory_is_bounded(monkeypatch):
    import kontor.llm.tokens as tokens

    monkeypatch.setattr(tokens, "MEMORY", 50)
    coder = tokens.TextEncoder(PATH)
    for k in range(20):
        texts = [f"word{chr(97 + k)}{chr(97 + j)} other{j}" for j in range(20)]
        counts = coder.counts(pa.array(texts, pa.large_string()))
        assert counts.tolist() == [len(x.ids) for x in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert len(coder.known) <= 100


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_libraries_go_whole(name):
    coder = encoder(public_tokenizers.path(name))
    assert not coder.chunked
    texts = ["Hello  world", "", "naïve\n\ntext"]
    flat, offsets = coder.ids(pa.array(texts, pa.large_string()))
    assert [flat[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [list(x) for x in coder.encode_whole(texts)]
    assert np.array_equal(coder.counts(pa.array(texts, pa.large_string())), np.diff(offsets))
