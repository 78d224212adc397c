"""Links of two tokenizers against a plain walk over both token sequences."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from emberday.llm import token_links as L
from emberday.llm.queries import tokenizer_file
from emberday.llm.sparse import Csr
from emberday.llm.tokens import byte_values

A, B = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
TEXTS = [
    "", None, " ", "a", "The quick  brown fox\n\n jumps,over", "▁bad text", "x ▁ y", "漢字 unknown 𒀀 é", "<|endoftext|> <s> a",
    "aaaa" * 100, "==" * 500 + "  " * 77 + "end ", "don't 12345 ½", "tab\t x  y \n z", " lead", "trail ", "a", "a b " * 4000,
]


@pytest.fixture(scope="module")
def walk():
    import sentencepiece
    from tokenizers import Tokenizer

    one, other = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    spelled = byte_values(A)

    def groups(text):
        if not text:
            return None
        a, b = one.encode(" " + text, add_special_tokens=False).ids, other.encode(text)
        names = [other.id_to_piece(i) for i in b]
        a_bytes = [spelled[i] for i in a]
        b_bytes = [bytes([int(n[3:5], 16)]) if other.is_byte(i) else n.replace("▁", " ").encode() for i, n in zip(b, names)]
        if b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            return None
        a_ends, b_ends = (np.cumsum(list(map(len, x))).tolist() for x in (a_bytes, b_bytes))
        found, i, j = [], 0, 0
        for end in sorted(set(a_ends) & set(b_ends)):
            p, q = a_ends.index(end) + 1, b_ends.index(end) + 1
            found.append((a[i:p], b[j:q]))
            i, j = p, q
        return found

    return groups


def expected(texts, walk):
    docs = [walk(t) for t in texts]
    links = [[(x, y) for a, b in d or [] for x in a for y in b] for d in docs]
    count = Counter(pair for found in links for pair in set(found))
    top = {}
    for (x, _), c in count.items():
        top[x] = max(top.get(x, 0), c)
    out = []
    for d, found in zip(docs, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in d or [])
        out.append(
            (
                sum(len(a) for a, _ in d or []), sum(len(b) for _, b in d or []), len(d or []), len(found),
                sum(count[x] == top[x[0]] for x in found), sum(count[x] for x in found),
                hashlib.sha256(text.encode()).hexdigest() if d else "",
            )
        )
    return out


def _random_texts(n):
    rng = random.Random(3)
    return ["".join(rng.choice("abc déf,. \n漢") for _ in range(rng.randint(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("chunk", [8 << 20, 2000])
def test_digests_equal_the_walk(spark, walk, monkeypatch, chunk):
    monkeypatch.setattr(L, "CHUNK_CHARACTERS", chunk)
    texts = TEXTS + _random_texts(150)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in L.link_digests(docs, A, B).collect()}
    assert [got[i] for i in range(len(texts))] == expected(texts, walk)


def test_repeated_null_and_clashing(spark, walk):
    rows = [(1, "a b", 1, 2), (1, "a b", 1, 2), (None, "c", 3, 4), (2, None, 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, chunk int, pair int")
    got = sorted((tuple(r) for r in L.link_digests(docs, A, B).collect()), key=str)
    assert got == sorted(((r[0], *e) for r, e in zip(rows, expected([r[1] for r in rows], walk))), key=str)
    assert L.link_digests(docs.limit(0), A, B).count() == 0


def test_groups_of_tokens(spark, walk):
    docs = spark.createDataFrame(list(enumerate(TEXTS[:12])), "doc_id long, text string")
    for r in L.aligned(docs, A, B).collect():
        found = [
            ([x for x, g in zip(r.a_ids, r.a_groups) if g == k], [x for x, g in zip(r.b_ids, r.b_groups) if g == k])
            for k in range(max(r.a_groups, default=-1) + 1)
        ]
        assert found == (walk(TEXTS[r.doc_id]) or [])


def test_row_products_equal_dense_products(monkeypatch):
    rng = np.random.default_rng(5)
    for terms in (1, 1 << 20):
        monkeypatch.setattr("emberday.llm.sparse.TERMS", terms)
        for _ in range(20):
            x, y = (rng.integers(0, 3, size) * (rng.random(size) < 0.4) for size in ((7, 9), (9, 5)))
            product = _csr(x) @ _csr(y)
            assert (_dense(product) == x @ y).all()
            assert (_dense(_csr(x).transposed()) == x.T).all()


def _csr(m):
    row, column = np.nonzero(m)
    return Csr(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(m)))]), column, m[row, column], m.shape[1])


def _dense(m):
    out = np.zeros((len(m), m.columns), np.int64)
    out[m.rows(), m.indices] = m.data
    return out
