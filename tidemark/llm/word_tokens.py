"""Token ids of whole texts by a word-level BPE vocabulary of the tokenizers library, remembered by word.

No token of such a vocabulary reaches over two of the library's pre-tokens, so a text's ids are those of its chunks,
one after another: the pre-tokens of a text of Latin-1 letters, the space-separated stretches of any other. Chunks
seen before come from a memory of bounded bytes; new ones go to the library in batches. Long chunks are never
remembered, so texts without spaces leave nothing behind.
"""

from __future__ import annotations

import itertools
import os
import re
import sys
from collections.abc import Iterable

import numpy as np

from .common import hold, trim

#: Bytes of chunks with their ids in each of two generations, the entry in the dictionary included, and the longest
#: chunk that is kept.
CACHE_BYTES, ENTRY_BYTES, LONGEST = 30_000_000, 100, 64

#: The vocabulary's pre-tokens, for lower-case texts of Latin-1: letters, contractions, single digits, runs of the rest.
_LETTERS, _DIGITS, _SPACES = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
PRE_TOKEN = re.compile(f"[{_LETTERS}]+|'(?:[stmd]|re|ve|ll)|[{_DIGITS}]|[^{_SPACES}{_LETTERS}{_DIGITS}]+")


class WordTokens:
    """Packed ids (little-endian unsigned 32-bit) of texts, exactly as the library gives them."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True) + 1, bool)
        self.ends[[i for word, i in vocab.items() if word.endswith("</w>")]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.young_bytes = 0
        self.marks = {c: self._whole(c) for c in ",."}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    @staticmethod
    def _chunks(text: str) -> list[str] | None:
        """None: the text may hold special tokens, and goes to the library whole."""
        if "<|" in text:
            return None
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text.replace("\n", " ").split(" ")
        return PRE_TOKEN.findall(text.lower())  # in these letters the library's lower case is the same, character by character

    def _learn(self, chunks: set[str]) -> None:
        """Ids of chunks that are in neither generation."""
        young, old = self.young, self.old
        words, others, ended = set(), [], []
        for c in chunks:
            if (value := old.get(c)) is not None:
                young[c] = value
            elif max(c, default="") > "\xff":  # lower case or composition may make other characters than letters
                others.append(c)
            elif c.isalpha():
                words.add(c)
            elif c[-1:] in self.marks and c[:-1].isalpha():
                ended.append(c)
                if (base := c[:-1]) not in young:
                    if (value := old.get(base)) is not None:
                        young[base] = value
                    else:
                        words.add(base)
            else:
                others.append(c)
        words = [*words]
        # Letters alone are one pre-token, which ends with an end-of-word id; so many words go through in one text.
        for k in range(0, len(words), 2000):
            part = words[k : k + 2000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part):
                packed, last = ids.tobytes(), 0
                for word, end in zip(part, (ends * 4).tolist()):
                    young[word] = packed[last:end]
                    last = end
            else:
                others += part
        # What the library gives for a text holds a kilobyte of offsets and strings, so few are asked for at a time.
        for k in range(0, len(others), 2000):
            part = others[k : k + 2000]
            for c, e in zip(part, self.tokenizer.encode_batch(part, add_special_tokens=False)):
                young[c] = np.array(e.ids, "<u4").tobytes()
        for c in ended:
            young[c] = young[c[:-1]] + self.marks[c[-1]]

    def encode_packed(self, texts: Iterable[str]) -> list[bytes]:
        split = [self._chunks(t) for t in texts]
        young = self.young
        before = len(young)
        found = [[*map(young.get, chunks)] if chunks is not None else [self._whole(t)] for t, chunks in zip(texts, split)]
        missing: set[str] = set()
        lacking = [i for i, values in enumerate(found) if None in values]
        for i in lacking:
            missing.update(c for c, v in zip(split[i], found[i]) if v is None)
        self._learn(missing)
        for i in lacking:
            found[i] = [young[c] if v is None else v for c, v in zip(split[i], found[i])]
        out = [*map(b"".join, found)]
        for c in list(itertools.islice(young, before, None)):
            if len(c) > LONGEST:
                del young[c]
            else:
                self.young_bytes += sys.getsizeof(c) + sys.getsizeof(young[c]) + ENTRY_BYTES
        if self.young_bytes > CACHE_BYTES:
            self.old, self.young, self.young_bytes = young, {}, 0
            trim()
        return out


def load(path: str) -> WordTokens:
    """One for each vocabulary file and worker process."""
    return hold(("WordTokens", path), lambda: WordTokens(path))


def text_blocks(texts: list[str], limit: int = 2_000_000) -> Iterable[slice]:
    """Slices of a list of about ``limit`` characters each, so that memory does not follow the batch size."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))
