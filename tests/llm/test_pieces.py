"""Piece encoding and decoding against the library itself, with and without a character map."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as proto

from emberday.llm import pieces as P
from emberday.llm.queries import tokenizer_file

PATH = tokenizer_file("piece_bpe_32k.model")
TEXTS = [
    "", "a", " ", "  a  b ", "Hé  漢字 \n\x00 ▁x 𒀀", "ﬁ ＡＢ é x", "　 x　y", "aaaa" * 50 + "bbbab" * 30, "▁", "▁▁ ▁",
    "don't 123 12,5 \t tab", "𒀀𒀁 ü" * 3, "half ½ ﷺ x\x01y", "\x01", " \x01 a", "<s> <0x0A> </s> <unk>", "a­b", "ﷺ ﷺ", "x " * 3000,
]


def models():
    spec = proto.ModelProto()
    with open(PATH, "rb") as f:
        spec.ParseFromString(f.read())
    yield "plain", spec.SerializeToString()
    for rule in ("nmt_nfkc", "nfkc_cf"):
        mapped = proto.ModelProto()
        mapped.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
        for dummy in (True, False):
            for squeeze in (True, False):
                spec.normalizer_spec.CopyFrom(mapped.normalizer_spec)
                spec.normalizer_spec.add_dummy_prefix = dummy
                spec.normalizer_spec.remove_extra_whitespaces = squeeze
                yield f"{rule}-{dummy}-{squeeze}", spec.SerializeToString()


@pytest.fixture(scope="module", params=list(models()), ids=lambda m: m[0])
def both(request, tmp_path_factory):
    path = tmp_path_factory.mktemp("model") / "m.model"
    path.write_bytes(request.param[1])
    return sentencepiece.SentencePieceProcessor(model_proto=request.param[1]), P.PieceEncoder(str(path))


def _texts(rng):
    signs = "ab eé漢 ́ﬁ　  ▁Ａ½\n\x01ﷺ"
    out = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    return out + ["".join(rng.choice("abcdefghinorst ") for _ in range(rng.randint(1, 200))) for _ in range(100)]


def test_ids_and_source_spans_equal_the_library(both):
    library, encoder = both
    texts = TEXTS + _texts(random.Random(1))
    for text, (ids, begins, ends) in zip(texts, encoder.encode(texts), strict=True):
        want = [(p.id, p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
        assert list(zip(ids.tolist(), begins.tolist(), ends.tolist())) == want, text


def test_decoding_equals_the_library_for_any_ids(both):
    library, encoder = both
    decode, rng = P.PieceDecoder(encoder.vocabulary).decode, random.Random(2)
    for _ in range(600):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(32000), 259, 1, 2, 0, 28705]) for _ in range(rng.randint(0, 12))]
        assert decode(np.array(ids, int)) == library.decode(ids), ids


def test_long_words_merge_like_short_ones(monkeypatch):
    words = ["▁" + "".join(random.Random(k).choice("aenrst") for _ in range(40)) for k in range(50)]
    vocabulary = P.PieceEncoder(PATH).vocabulary
    together = [x.tolist() for x in P.merged(vocabulary, words)]
    monkeypatch.setattr(P, "LONG_WORD", 8)
    assert [x.tolist() for x in P.merged(vocabulary, words)] == together


def test_other_models_are_refused(tmp_path):
    spec = proto.ModelProto()
    with open(PATH, "rb") as f:
        spec.ParseFromString(f.read())
    spec.trainer_spec.byte_fallback = False
    (tmp_path / "m.model").write_bytes(spec.SerializeToString())
    with pytest.raises(ValueError):
        P.PieceEncoder(str(tmp_path / "m.model"))


def test_tables(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = [(i % 7, t, 1) for i, t in enumerate([*TEXTS, None, "a", "a"])] + [(None, "no id", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    want = []
    for doc_id, text, _ in rows:
        ids = library.encode(text or "")
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids))]
        want.append((doc_id, len(ids), *sha))
    got = [tuple(r)[:4] for r in P.encoded_digests(docs, PATH).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)

    encoded = P.encoded(docs, PATH)
    back = P.decoded(encoded, PATH).collect()
    # a place mark of the source comes back as a space
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(d), (t or "").replace("▁", " ")) for d, t, _ in rows)
    empty = docs.limit(0)
    assert P.encoded_digests(empty, PATH).count() == 0 and P.encoded(empty, PATH).count() == 0
