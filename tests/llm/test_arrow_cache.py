"""The word cache of the token files: what it keeps between tasks, what it drops, and ids as the library gives them."""

import random

import pyarrow as pa

from factloom.llm import token_store
from factloom.llm.queries import tokenizer

PATH = tokenizer("word_bpe_49k.json")


def _texts(r, n):
    words = ["".join(r.choice("abcdeéÉİß") for _ in range(r.randint(1, 9))) + r.choice(["", ".", ",.", "##", "7"]) for _ in range(200)]
    return [None, "", " ", "\n", "Σίσυφος ΟΔΟΣ", "日本語 🙂", "<|endoftext|> x", *(" ".join(r.choices(words, k=r.randint(1, 40))) for _ in range(n))]


def test_words_of_an_earlier_task_are_not_encoded_again(monkeypatch):
    encoder, asked = token_store.ChunkEncoder(PATH), []
    for cache in (encoder.words, encoder.others):
        monkeypatch.setattr(cache, "encode", lambda keys, f=cache.encode: (asked.extend(keys), f(keys))[1])
    texts = pa.array(_texts(random.Random(3), 50))
    first = encoder.encode(texts, 1)
    n = len(asked)
    for _ in token_store.trimmed(iter([]), *filter(None, [getattr(encoder, "forget", None)])):  # a task ends
        pass
    assert n and encoder.encode(texts, 1).equals(first) and len(asked) == n == len(set(asked))


def test_a_full_cache_gives_the_ids_of_the_library():
    encoder, r = token_store.ChunkEncoder(PATH), random.Random(4)
    for cache in (encoder.words, encoder.others):
        cache.limit = 30
    for kind in (pa.string(), pa.large_string()):
        for n in (0, 3, 60, 0, 60):
            texts = _texts(r, n)
            want = [[*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 9] for t in texts]
            assert encoder.encode(pa.array(texts, kind), 9).to_pylist() == want
            assert encoder.encode(pa.array(texts, kind)).to_pylist() == [w[:-1] for w in want]
            assert len(encoder.words.words) <= 30 >= len(encoder.others.words)
