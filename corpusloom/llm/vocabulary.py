"""Token ids of white-space words through a public tokenizer, inside tasks.

The word-level vocabularies used here never join text across ASCII white
space, so a text's ids are its words' ids one after another. Words are encoded
once per worker while they stay in a bounded memory.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import words as W

#: Words remembered by one worker.
MEMORY = 700_000
_PLAIN = re.compile("[a-zß-öø-ÿ]{1,100}").fullmatch
#: Letters of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTER = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


def plain_words(text: pa.Array) -> pa.Array:
    """Texts of the same ids with fewer distinct words.

    A to Z become small, and ASCII marks (but apostrophes) that end a word get
    a space before them: the tokenizer does the one and cuts at the other
    anyway. Texts with combining marks, which compose differently, or with
    special strings stay as they are.
    """
    text = pc.fill_null(text.cast(pa.large_string()), "")
    kept = pc.match_substring_regex(text, r"\p{M}|<\|")
    plain = pc.replace_substring_regex(pc.ascii_lower(text), r"([a-zß-öø-ÿ])([!-&(-/:-@\[-`{-~]+)([ \n])", r"\1 \2\3")
    if not pc.any(kept).as_py():
        return plain
    at = np.arange(len(text)) + len(text) * kept.to_numpy(zero_copy_only=False)
    return pa.concat_arrays([plain, text]).take(pa.array(at))


class Encoder:
    """Ids of words, the same as ``Tokenizer.encode(word, add_special_tokens=False)``."""

    def __init__(self, path: str, memory: int = MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.memory = Tokenizer.from_file(path), memory
        self.forget()
        # small letters go to the model at once, only if that changes nothing
        probe = ["the", "mixture", "ofthhahaen", "s", "é", "straße", "çãñöx"]
        self.fast = [self._small(w) for w in probe] == self._encode(probe)

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.ends = array("I"), array("q", [0])

    def _small(self, word: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize("".join([_LETTER[b] for b in word.encode()]))]

    def _encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def table(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the words, for gathering."""
        if len(self.place) + len(words) > self.memory:
            self.forget()
        place = self.place
        new = [w for w in words if w not in place]
        small = [w for w in new if self.fast and _PLAIN(w)]
        known = set(small)
        other = [w for w in new if w not in known]
        self._keep(small, map(self._small, small))
        for lo in range(0, len(other), 1000):
            self._keep(other[lo:lo + 1000], self._encode(other[lo:lo + 1000]))
        at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        ends = np.array(self.ends)
        count = ends[at + 1] - ends[at]
        return np.concatenate(([0], np.cumsum(count))), np.array(self.ids)[W.take_ranges(ends[at], count)]

    def _keep(self, words, ids) -> None:
        for word, own in zip(words, ids, strict=True):
            self.place[word] = len(self.place)
            self.ids.extend(own)
            self.ends.append(len(self.ids))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
