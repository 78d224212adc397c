"""A worker's word table stays small, and forgetting words changes no id."""

import random
import tracemalloc

import numpy as np

from emberday.llm import queries as Q
from emberday.llm import shingles as S
from emberday.llm.tokens import Encoder

PATH = Q.tokenizer_file("byte_bpe_50k.json")


def test_words_met_again_are_kept_and_ids_stay():
    rng = random.Random(3)
    common = [f"word{i}" for i in range(20)]
    small, large = Encoder(PATH, known=100), Encoder(PATH)
    for k in range(40):
        texts = [" ".join(rng.choices(common, k=30) + [f"once{k}x{j}"]) for j in range(6)] + [None, ""]
        for a, b in zip(small.encode(texts), large.encode(texts)):
            assert a.tolist() == b.tolist()
        assert len(small._codes) <= 100 + 60
    assert set(common) <= set(small._codes)


def test_no_more_than_half_the_table_is_kept():
    small, plain = Encoder(PATH, known=10), Encoder(PATH)
    texts = [" ".join(f"w{i}," for i in range(50))] * 2
    for _ in range(3):
        assert [x.tolist() for x in small.encode(texts)] == [x.tolist() for x in plain.encode(texts)]
    small._tidy()
    assert len(small._codes) <= 5


def test_words_of_a_buffer_take_bounded_memory():
    buffer = np.frombuffer(b"some words of a text " * 200_000, np.uint8)
    tracemalloc.start()
    S.words(buffer)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 45 << 20
