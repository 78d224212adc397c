import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberday.llm import mixing as M
from emberday.llm import token_counts as C
from emberday.llm import token_store as T
from emberday.llm.queries import tokenizer_file
from emberday.llm.tokens import Encoder

PATH = tokenizer_file("byte_bpe_50k.json")
TEXTS = [
    "The quick brown fox, it's 's here.", "", None, " ", " a", "a ", "  two  spaces ", "x\ny", "\n\nab c", "tab\tand nbsp   em",
    "<|endoftext|> plain <|endoftext|>", "É ñ 漢字 1234 !!! ...", "a.b,c;d 'll don't", "word " * 20_000 + "end", "😀 " * 50, "The quick brown fox, it's 's here.",
]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


def test_encoder_equals_the_library(reference):
    encode = Encoder(PATH)
    for _ in range(2):  # unknown, then known words
        ids, counts = encode.encode(TEXTS)
        parts = np.split(ids, np.cumsum(counts)[:-1])
        assert [p.tolist() for p in parts] == [reference(t) for t in TEXTS]


@pytest.mark.parametrize("top", [1, 256, 70_000, 2**32])
def test_segment_round_trip_and_random_access(top):
    rng = np.random.default_rng(top)
    ids = rng.integers(0, top, 3000).astype(np.uint32)
    ids[::7] = 0
    segment = T.Segment(T.pack(ids))
    assert (segment.all() == ids).all() and len(segment) == 3000
    assert all(segment[i] == ids[i] for i in range(0, 3000, 11))
    assert len(T.Segment(T.pack(np.empty(0, np.uint32))).all()) == 0
    with pytest.raises(IndexError):
        segment[3000]


def test_store_round_trip(spark, reference, monkeypatch):
    monkeypatch.setattr(T, "SEGMENT_TOKENS", 500)
    docs = [(100 - i, t, 7) for i, t in enumerate(TEXTS)] + [(None, "no id", 7), (95, "again", 7)]
    df = spark.createDataFrame(docs, "doc_id long, text string, start int")
    got = sorted((r.doc_id is not None, r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in T.encoded_documents(df, PATH, 3).collect())
    hashed = df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    order = [(r.doc_id, r.text) for r in sorted(hashed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))]
    want, at = [], 0
    for doc_id, text in order:
        ids = np.array(reference(text) + [0], "<u4")
        want.append((doc_id is not None, doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == sorted(want)
    assert T.encoded_documents(df.limit(0), PATH, 3).count() == 0


def test_tokens_at_positions(spark, reference, tmp_path):
    df = spark.createDataFrame([(i, f"text number {i} " * (i + 1)) for i in range(30)], "doc_id long, text string")
    T.write_store(df, PATH, str(tmp_path / "store"), 3)
    stream = [t for i in range(30) for t in reference(f"text number {i} " * (i + 1)) + [0]]
    wanted = [0, 5, 5, len(stream) - 1, len(stream), -1, len(stream) // 2]
    positions = spark.createDataFrame([(p,) for p in wanted], "position long")
    got = sorted((r.position, r.token_id) for r in T.tokens_at(spark.read.parquet(str(tmp_path / "store")), positions).collect())
    assert got == sorted((p, stream[p]) for p in wanted if 0 <= p < len(stream))


# --- edits


def test_edits_keep_the_exact_count(reference):
    encode, rng = Encoder(PATH), random.Random(1)
    inserts = [" ", "  ", "\n", " \n", "x", "the end", "it's", "...", " a ", "é ñ", "", "\t", "12 3", "word " * 400]
    for text in [t or "" for t in TEXTS[:-3]] + ["some words here " * 300]:
        tree, now = C.CountTree(text, encode), text
        for _ in range(25):
            start = rng.randint(-1, len(now) + 1)
            stop, insert = start + rng.choice([-3, 0, 1, 5, 60, 2000]), rng.choice(inserts)
            tree.edit(start, stop, insert)
            a = max(0, min(start, len(now)))
            now = now[:a] + insert + now[max(a, min(stop, len(now))) :]
            assert tree.text == now and tree.total == len(reference(now))


def test_an_edit_reads_only_its_region():
    tree = C.CountTree("plain words in a row " * 5000, Encoder(PATH))
    tree.edit(50_000, 50_004, "new")
    assert tree.read < 60


def test_edited_counts(spark, reference):
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)] + [(None, "no id", 0)], "doc_id long, text string, n_tokens int")
    edits = spark.createDataFrame(
        [(0, 2, 0, 3, "A"), (0, 1, 5, 5, "very "), (1, 1, 9, 99, "put in"), (2, 1, None, None, None), (999, 1, 0, 0, "x")],
        "doc_id long, seq int, start int, stop int, insert string",
    )
    rows = {r.doc_id: r for r in C.edited_counts(C.attach_edits(docs, edits), PATH).collect()}
    assert len(rows) == len(TEXTS) + 1
    assert rows[0].n_tokens == len(reference(TEXTS[0]))
    assert rows[0].n_tokens_edited == len(reference("A" + (TEXTS[0][:5] + "very " + TEXTS[0][5:])[3:])) and rows[0].n_edits == 2
    assert rows[1].n_tokens == 0 and rows[1].n_tokens_edited == len(reference("put in"))
    assert rows[3].n_edits == 0 and rows[3].n_tokens_edited == rows[3].n_tokens
    assert C.edited_counts(C.attach_edits(docs.limit(0), edits), PATH).count() == 0


# --- mixing

def levels():
    return [
        M.Level("domain", F.col("d"), F.expr("case domain when 'a' then 3.0 when 'b' then 1.0 when 'z' then 0.0 else 1.0 end")),
        M.Level("lang", F.col("lang"), F.expr("case lang when 'en' then 2.0 else 1.0 end")),
        M.Level("source", F.col("source"), F.lit(1.0)),
    ]


def fill(budget, rooms, weights):
    """Shares of siblings by repeated redistribution."""
    share = dict.fromkeys(rooms, 0.0)
    open_ = {k for k in rooms if weights[k] > 0}
    left = budget
    while open_ and left > 1e-9:
        total = sum(weights[k] for k in open_)
        full = {k for k in open_ if rooms[k] - share[k] <= left * weights[k] / total + 1e-12}
        if not full:
            for k in open_:
                share[k] += left * weights[k] / total
            return share
        for k in full:
            left -= rooms[k] - share[k]
            share[k] = rooms[k]
        open_ -= full
    return share


def test_budgets_match_step_by_step_redistribution(spark):
    rng = random.Random(3)
    leaves = [(d, lang, f"s{k}", rng.choice([1, 5, 40, 300])) for d in "abcz" for lang in ("en", "de", "fr") for k in range(rng.randint(1, 4))]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    weight = {"a": 3.0, "b": 1.0, "c": 1.0, "z": 0.0}
    room = {r[:3]: 2 * r[3] * (weight[r[0]] > 0) for r in leaves}
    for budget in (10, 500, 2000, 10**6):
        got = {(r.domain, r.lang, r.source): r.quota for r in M.budgets(df, levels(), budget, 2).collect()}

        def rooms(depth, prefix):
            out = {}
            for k, v in room.items():
                if k[:depth] == prefix:
                    out[k[depth]] = out.get(k[depth], 0) + v
            return out

        want = {}
        for d, b in fill(budget, rooms(0, ()), weight).items():
            for lang, c in fill(b, rooms(1, (d,)), {"en": 2.0, "de": 1.0, "fr": 1.0}).items():
                below = rooms(2, (d, lang))
                for s, q in fill(c, below, dict.fromkeys(below, 1.0)).items():
                    want[d, lang, s] = q
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) <= 1 for k in got), budget


def test_mixture_takes_token_prefixes_of_seeded_epochs(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice("aab"), rng.choice(["en", "de", None]), "s", 1) for i in range(400)]
    docs += [(None, "w w w", "a", "en", "s", 1), (7, docs[7][1], *docs[7][2:]), (500, None, "a", "en", "s", 1), (501, "", "b", "de", "s", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, d string, lang string, source string, taken int")
    total = sum(len((t or "").split()) for _, t, *_ in docs)
    out = M.mixture(df, levels(), 0.7, 3).collect()
    again = M.mixture(df.repartition(5), levels(), 0.7, 3).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, out)) == sorted(map(key, again))
    taken = sum(r.taken for r in out)
    assert int(total * 0.7) - 8 <= taken <= int(total * 0.7)
    sizes = {}
    for i, t, d, lang, s, _ in docs:
        sizes.setdefault((d, lang or "(none)"), []).append(len((t or "").split()))
    for leaf, tokens in sizes.items():
        mine = [r for r in out if (r.domain, r.lang) == leaf]
        last = max((r.epoch for r in mine), default=0)
        # every epoch but the last takes the whole leaf
        for e in range(last):
            assert sum(r.taken for r in mine if r.epoch == e) == sum(tokens)
        assert sum(r.taken < r.tokens for r in mine if r.epoch == last) <= 2
    mixed = M.mixed(df, levels(), 0.7, 3)
    assert mixed.columns == df.columns
    assert sorted(map(str, (r.doc_id for r in mixed.collect()))) == sorted(str(r.doc_id) for r in out)
    assert M.mixture(df.limit(0), levels(), 0.7, 3).count() == 0 and M.mixed(df.limit(0), levels(), 0.7, 3).count() == 0
