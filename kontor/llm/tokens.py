"""Token ids and counts of whole texts, exactly as the tokenizer library gives them, with a bounded memory of word pieces.

Some tokenizers lower the case, drop white space and merge only inside pretokens. For those, a text's ids are the ids
of its pretokens, one after another; each worker remembers pretokens, and the library encodes only those it has not
met. Texts with characters outside ASCII and Latin letters, or with a special token's string, and all other
tokenizers, go to the library whole.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from kontor.llm.common import ragged

MEMORY = 400_000
#: Bytes of text per step: fewer, larger steps look up each distinct pretoken less often.
TOKEN_STEP = 4 << 20
#: The one pretokenizer pattern that ``pretokens`` cuts by (a fixed value of the vocabulary file).
_PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts of printable ASCII, white space and Latin letters, whose case and composition rules are the same in every library.
_PLAIN = r"^[\t-\r -~\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]*$"
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[ord("0"):ord("9") + 1] = _DIGIT
_KIND[ord("a"):ord("z") + 1] = _LETTER
_KIND[128:] = _LETTER


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file and the library's version: counts of another version are never reused."""
    import sentencepiece
    import tokenizers

    library = sentencepiece.__version__ if path.endswith(".model") else tokenizers.__version__
    with open(path, "rb") as file:
        return hashlib.sha256(file.read() + library.encode()).hexdigest()


def pretokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All pretokens of plain texts as bytes, and the offsets of each text's pretokens."""
    low = pc.utf8_lower(texts)
    _, where, data = low.buffers()
    edges = np.frombuffer(where, np.int64)[low.offset:low.offset + len(low) + 1]
    held = np.frombuffer(data, np.uint8)[edges[0]:edges[-1]] if data is not None else np.zeros(0, np.uint8)
    edges = edges - edges[0]
    n = len(held)
    kind = _KIND[held]
    head = np.ones(n, bool)
    head[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    head[edges[:-1][edges[:-1] < n]] = True
    quotes = np.flatnonzero((held == ord("'")) & head)
    if len(quotes):  # 's 't 'm 'd 're 've 'll, inside one text
        stop = edges[np.searchsorted(edges, quotes, side="right")]
        padded = np.concatenate([held, np.zeros(2, np.uint8)])
        one, two = padded[quotes + 1], padded[quotes + 2]
        pair = one.astype(np.int32) << 8 | two
        short = (quotes + 1 < stop) & np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = (quotes + 2 < stop) & np.isin(pair, [ord(x[0]) << 8 | ord(x[1]) for x in ("re", "ve", "ll")])
        suffix = quotes[short | long]
        after = suffix + np.where(short[short | long], 2, 3)
        head[suffix + 1] = False
        head[after[after < n]] = True
    solid = kind != _SPACE
    place = np.cumsum(solid, dtype=np.int32 if n < 1 << 31 else np.int64)
    starts = np.flatnonzero(head & solid)
    offsets = np.concatenate([place[starts] - 1, place[-1:]]).astype(np.int64) if n else np.zeros(1, np.int64)
    flat = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(held[solid])])
    return flat, np.searchsorted(starts, edges)


class TextEncoder:
    """Encodes batches of texts; ``chunked`` says whether pretokens are remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.chunked = False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode_whole = lambda texts: model.encode(texts, num_threads=1)
            self.vocabulary = model.vocab_size()
            return
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.encode_whole = lambda texts: [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        self.vocabulary = self.tokenizer.get_vocab_size()
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        steps = [x.get("type") for x in (told.get("normalizer") or {}).get("normalizers", [])]
        first = ((told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.specials = [x["content"] for x in told.get("added_tokens", [])]
        self.chunked = bool(
            steps == ["NFC", "Replace", "Lowercase"] and told["model"]["type"] == "BPE" and told["model"].get("dropout") is None
            and [x.get("type") for x in told["pre_tokenizer"]["pretokenizers"]] == ["Split", "ByteLevel"]
            and first.get("behavior") == "Removed" and first.get("invert") and first.get("pattern") == {"Regex": _PRETOKEN}
            and not any(regex.search(r"\s", x) for x in self.specials))
        if self.chunked:
            # byte-level vocabularies write bytes that are no printable letters as letters from 256 on
            hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
            self.letters = {b: 256 + k for k, b in enumerate(hidden)}
            self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.pool, self.filled = np.zeros(1 << 20, np.uint32), 0
        self.starts, self.lengths = np.zeros(1 << 17, np.int64), np.zeros(1 << 17, np.int64)

    def _learn(self, wanted: list[bytes]) -> None:
        """Remember the ids of new pretokens, given by the library's merge model for their byte letters."""
        ids, sizes, model = [], [], self.tokenizer.model
        for word in wanted:
            found = model.tokenize(word.decode() if word.isascii() else word.decode("latin-1").translate(self.letters))
            ids.extend([x.id for x in found])
            sizes.append(len(found))
        while self.filled + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        have, more = len(self.known), len(sizes)
        while have + more > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        self.pool[self.filled:self.filled + len(ids)] = ids
        self.lengths[have:have + more] = sizes
        self.starts[have:have + more] = self.filled + np.cumsum([0, *sizes[:-1]])
        self.filled += len(ids)
        self.known.update(zip(wanted, range(have, have + more)))

    def _places(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Memory place of every pretoken, and the offsets of each text's pretokens."""
        flat, offsets = pretokens(texts)
        coded = flat.dictionary_encode()
        names = coded.dictionary.to_pylist()
        if not names:
            return np.zeros(0, np.int64), offsets
        if len(self.known) + len(names) > max(MEMORY, 2 * len(names)):
            missing = sum(x not in self.known for x in names)
            if len(self.known) + missing > MEMORY:
                self.forget()
        new = [x for x in names if x not in self.known]
        if new:
            self._learn(new)
        places = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))
        return places[np.asarray(coded.indices)], offsets

    def _plain(self, texts: pa.Array) -> np.ndarray:
        if not self.chunked:
            return np.zeros(len(texts), bool)
        plain = pc.match_substring_regex(texts, _PLAIN)
        for special in self.specials:
            plain = pc.and_not(plain, pc.match_substring(texts, special))
        return np.asarray(plain)

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Token count of every text."""
        plain = self._plain(texts)
        out = np.zeros(len(texts), np.int64)
        if plain.any():
            places, offsets = self._places(texts.filter(pa.array(plain)))
            before = np.concatenate([[0], np.cumsum(self.lengths[places])])
            out[plain] = np.diff(before[offsets])
        if not plain.all():
            out[~plain] = [len(x) for x in self.encode_whole(texts.filter(pa.array(~plain)).to_pylist())]
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one text after another, and each text's offsets."""
        plain = self._plain(texts)
        flat, starts, lengths = np.zeros(0, np.uint32), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        if plain.any():
            places, offsets = self._places(texts.filter(pa.array(plain)))
            sizes = self.lengths[places]
            before = np.concatenate([[0], np.cumsum(sizes)])
            flat = self.pool[ragged(self.starts[places], sizes)]
            starts[plain], lengths[plain] = before[offsets[:-1]], np.diff(before[offsets])
        if not plain.all():
            found = self.encode_whole(texts.filter(pa.array(~plain)).to_pylist())
            sizes = np.array([len(x) for x in found], np.int64)
            starts[~plain], lengths[~plain] = len(flat) + np.cumsum(sizes) - sizes, sizes
            flat = np.concatenate([flat, np.array([y for x in found for y in x], np.uint32)])
            flat = flat[ragged(starts, lengths)]
        return flat, np.concatenate([[0], np.cumsum(lengths)])


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    """One encoder per worker process and vocabulary file."""
    return TextEncoder(path)
