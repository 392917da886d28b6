"""The memory of chunks is bounded by bytes and never changes ids."""

import random
import struct

import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import word_tokens

WORD = public_tokenizers.path("word_bpe_49k.json")


def test_long_chunks_leave_nothing_and_generations_are_bounded(monkeypatch):
    monkeypatch.setattr(word_tokens, "CACHE_BYTES", 20_000)
    library = Tokenizer.from_file(WORD)
    memory = word_tokens.WordTokens(WORD)
    rng = random.Random(5)
    for _ in range(30):
        texts = ["".join(chr(rng.randrange(0x4E00, 0x5000)) for _ in range(2000)), "x" * 500 + ",", "a" * 64 + " " + "b" * 65 + "."]
        texts += [" ".join("".join(rng.choice("abcdé,.") for _ in range(rng.randint(0, 9))) for _ in range(60)) for _ in range(4)]
        for t, packed in zip(texts, memory.encode_packed(texts)):
            assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == library.encode(t, add_special_tokens=False).ids
        kept = [*memory.young, *memory.old]
        assert all(len(c) <= word_tokens.LONGEST for c in kept) and len(kept) < 600
    assert memory.old


def test_a_word_is_learned_once_whatever_stands_around_it():
    library, memory = Tokenizer.from_file(WORD), word_tokens.WordTokens(WORD)
    letters = "".join(map(chr, range(256)))
    rng = random.Random(6)
    texts = ["Harbour### harbour$$$ harbour, (harbour) harbour's", letters, *letters, *(f"a{c}b1{c}{c}'s" for c in letters)]
    texts += [f"it'{x} I'{x.upper()} ''{x}'{x}'" for x in ("s", "t", "re", "ve", "m", "ll", "d", "rev", "sx")]
    texts += ["".join(rng.choice(letters + "''stmdrevl.,  É字ﬁſ"[: 14 + 5 * (k % 2)]) for _ in range(40)) for k in range(300)]
    assert memory.encode_packed(texts[:1]) and set(memory.young) == {"harbour", "###", "$$$", ",", "(", ")", "'s"}
    for t, packed in zip(texts, memory.encode_packed(texts)):
        assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == library.encode(t, add_special_tokens=False).ids
