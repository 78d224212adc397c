"""Literal special strings get the ids the tokenizers library gives by default."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from emberday.llm import queries as Q
from emberday.llm import token_counts as C
from emberday.llm.tokens import Encoder

PATH = Q.tokenizer_file("byte_bpe_50k.json")
END = "<|endoftext|>"
TEXTS = [
    f"a {END} b", END, f" {END}", f"{END} ", f"x{END}y", f"word, {END}. more", f"{END}{END} {END}", f"a  {END}\n b", f"{END}  two",
    f"it's{END}'s 's {END}'s", f"<|{END}|> <|endoftext |> <|endoftext", f"é{END}漢 {END}é", None, "", "plain words, twice plain",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


def test_encoder_reads_special_strings_as_the_library(library):
    assert library(TEXTS[0]) == [64, 220, 50256, 275]
    rng = random.Random(4)
    parts = [END, " ", " ", "a", "word", "\n", "  ", ".", "'s", "é", "<|", "|>", "1"]
    texts = TEXTS + ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(3000)]
    encode = Encoder(PATH, special=True)
    for _ in range(2):  # unknown, then known words
        ids, counts = encode.encode(texts)
        got = np.split(ids, np.cumsum(counts)[:-1])
        assert [p.tolist() for p in got] == [library(t) for t in texts]
    leaves = list(encode.word_counts(texts))
    assert [int(sum(n)) for _, n in leaves] == [len(library(t)) for t in texts]


def test_edits_that_make_and_break_special_strings(library):
    encode, rng = Encoder(PATH, special=True), random.Random(2)
    for text in [t or "" for t in TEXTS] + [f"some {END} words<|endof here " * 40]:
        tree, now = C.CountTree(text, encode), text
        for _ in range(40):
            start = rng.randint(0, len(now))
            stop, insert = start + rng.choice([0, 1, 5, 30]), rng.choice([END, f" {END}", "<|endof", "text|>", " ", "", "x"])
            tree.edit(start, stop, insert)
            now = now[:start] + insert + now[min(stop, len(now)) :]
            assert tree.text == now and tree.total == len(library(now))


def test_registered_queries_use_the_default_reading(spark, library, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = {i: np.array(library(t) + [0], "<u4") for i, t in rows}
    sums = {i: (len(ids), zlib.crc32(ids.tobytes())) for i, ids in want.items()}
    stored = Q.op5_directly_addressable_tokens(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in stored} == sums
    last = corpus_pipeline.token_files(spark, docs, str(tmp_path)).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in last} == sums
    counted = Q.op6_edit_aware_counts(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.n_tokens for r in counted} == {i: len(ids) - 1 for i, ids in want.items()}
