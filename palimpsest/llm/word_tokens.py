"""Whole-text encoding with a word-level tokenizer file, each distinct word once."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct words that each half of a memory holds; longer words are not held.
CACHE_WORDS = 400_000
LONG_WORD = 64
#: Letters before this one keep their form under NFC, and all but one have one small form.
LATIN_END = "\u0250"
LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
#: Punctuation that is looked up apart from the letters before it: all of ASCII.
ENDS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum())
#: Runs that are put together at a time.
SPREAD = 1 << 16
#: How byte-level vocabularies write bytes that aren't printable Latin-1: from 256 up, in order.
_printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_SYMBOLS = {byte: 256 + n for n, byte in enumerate(b for b in range(256) if b not in _printable)}


class Halves:
    """A bounded memory: when its recent half is full, that becomes the older half and the older one goes."""

    def __init__(self, room: int) -> None:
        self.room = room
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def trim(self) -> None:
        if len(self.recent) > self.room:
            self.older, self.recent = self.recent, {}

    def fill(self, keys: list[str], make: Callable[[str], bytes]) -> list[bytes]:
        """What belongs to each key, in order, made where it isn't known."""
        recent, older = self.recent, self.older
        values = list(map(recent.get, keys))
        if None in values:
            for i, value in enumerate(values):
                if value is None:
                    key = keys[i]
                    value = recent.get(key) or older.get(key)
                    if value is None:
                        value = make(key)
                    if len(key) <= LONG_WORD:
                        recent[key] = value
                    values[i] = value
        return values


def spread(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``values`` with these starts and lengths, one behind the other."""
    ends = lengths.cumsum()
    out = np.empty(ends[-1] if len(ends) else 0, dtype=values.dtype)
    for i in range(0, len(ends), SPREAD):
        begin, length, end = starts[i : i + SPREAD], lengths[i : i + SPREAD], ends[i : i + SPREAD]
        first = end[0] - length[0]
        out[first : end[-1]] = values[np.repeat(begin - end + length, length) + np.arange(first, end[-1])]
    return out


class WordEncoder:
    """Encodes texts with a tokenizer that never joins characters across white space.

    Between two pieces of ASCII white space, such a tokenizer gives the same ids
    whatever stands around, so ids are looked up by word, each different word of a
    group of texts once. It also splits letters from the punctuation behind and
    lower-cases them: of plain Latin letters, to which its normaliser does nothing else,
    only the small form is looked up, and if it is new it goes right to the merges; any
    other word goes through the whole of it.
    """

    def __init__(self, tokenizer_file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.merges = self.tokenizer.model.tokenize
        added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        # These may stand across words or within plain ones; a word that holds any other isn't plain.
        self.apart = [token for token in added if re.search(r"\s", token) or re.fullmatch(f"[{LETTERS}]*[{re.escape(ENDS)}]*", token)]
        self.words = Halves(CACHE_WORDS)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if not word.isalpha():
            return self._whole(word)
        if not word.isascii():
            if max(word) >= LATIN_END or "\u0130" in word:
                return self._whole(word)
            word = word.encode().decode("latin-1").translate(BYTE_SYMBOLS)
        return array("I", [token.id for token in self.merges(word)]).tobytes()

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids that hold those of each word, and where these start and how many they are."""
        plain = pc.match_substring_regex(words, rf"^[{LETTERS}]+[{re.escape(ENDS)}]*$")
        cores = pc.if_else(plain, pc.utf8_lower(pc.ascii_rtrim(words, characters=ENDS)), words).dictionary_encode()
        tails = pc.replace_substring_regex(pc.if_else(plain, words, ""), f"^[{LETTERS}]+", "").dictionary_encode()
        keys = pa.concat_arrays([cores.dictionary, tails.dictionary]).to_numpy(zero_copy_only=False).tolist()
        parts = self.words.fill(keys, self._word)
        at = np.stack([cores.indices.to_numpy(), tails.indices.to_numpy() + len(cores.dictionary)], axis=1).ravel()
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        ids = spread(np.frombuffer(b"".join(parts), dtype="<u4"), (lengths.cumsum() - lengths)[at], lengths[at])
        lengths = lengths[at].reshape(-1, 2).sum(axis=1)
        return ids, lengths.cumsum() - lengths, lengths

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all whole texts, one behind the other, and how many each has; no text may be null."""
        self.words.trim()
        if any(pc.any(pc.match_substring(texts, token)).as_py() for token in self.apart):
            each = [self._whole(text) for text in texts.to_pylist()]
            return np.frombuffer(b"".join(each), dtype="<u4"), np.array([len(x) // 4 for x in each], dtype=np.int64)
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        ids, starts, lengths = self._distinct(words.dictionary)
        at, edges = words.indices.to_numpy(), lists.offsets.to_numpy()
        passed = np.concatenate([[0], lengths[at].cumsum()])
        return spread(ids, starts[at], lengths[at]), np.diff(passed[edges - edges[0]])

    def encode_bytes(self, text: str) -> bytes:
        """Ids of the whole text, each as four little-endian bytes."""
        return self.encode_all(pa.array([text], pa.string()))[0].tobytes()


@cache
def word_encoder(tokenizer_file: str) -> WordEncoder:
    """One encoder for all tasks of a Python worker, so that what it learnt stays."""
    return WordEncoder(tokenizer_file)
