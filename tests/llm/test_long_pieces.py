"""No letter piece of the vocabulary is left out for its length."""

import numpy as np

from emberday.llm import langid as L
from emberday.llm.queries import tokenizer_file

PIECES = tokenizer_file("piece_bpe_32k.model")


def test_vocabulary_keeps_every_letter_piece():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    every = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    letters = {p for p in every if p.removeprefix("▁").isalpha() or p == "▁"}
    kept = set(L.vocabulary(PIECES))
    assert kept >= letters and {"▁industry", "production", "▁reported", "▁биография"} <= kept


def test_long_pieces_are_summed_in_words():
    long = "▁" + "abcdefghij" * 4  # the longest marked word
    pieces = ["▁", "▁industry", "production", long]
    logs = np.log(np.array([[0.1, 0.4], [0.2, 0.3], [0.3, 0.2], [0.4, 0.1]]))
    words = ["industry", "industryproduction", long[1:]]
    got = np.exp(L.word_logs(L.Pieces(pieces), logs, words))
    floor = L._FLOOR
    p = np.exp(logs)
    want = [
        p[1] + p[0] * floor**8, p[1] * p[2] + p[0] * floor**8 * p[2] + p[1] * floor**10 + p[0] * floor**18, p[3] + p[0] * floor**40,
    ]
    assert np.allclose(got, want, rtol=1e-9)
    counts = L.expected_counts(L.Pieces(pieces), logs, words, np.ones(3), np.zeros(3, int))
    assert np.allclose(counts[1:, 0], [2, 1, 1], atol=1e-3)


def test_words_of_any_length_are_summed_whole(monkeypatch):
    rng = np.random.default_rng(3)
    letters = "abcde"
    words = ["".join(rng.choice(list(letters), n)) for n in (1, 2, 7, 23, 40, 40)]
    pieces = sorted({"▁", *letters[:4], *("".join(rng.choice(list(letters), n)) for n in (2, 2, 3, 3, 4, 9)), "▁a", "▁ab"})
    logs = np.log(rng.dirichlet(np.ones(len(pieces)), 3).T)
    index, counts, lang = L.Pieces(pieces), np.arange(1, 7), np.array([0, 1, 2, 0, 1, 2])
    want = L.word_logs(index, logs, words), L.expected_counts(index, logs, words, counts, lang)
    # now one by one, rescaled often, in short stretches
    monkeypatch.setattr(L, "MAX_WORD", 0)
    monkeypatch.setattr(L, "_SMALL", 1e-3)
    monkeypatch.setattr(L, "_STRETCH", 5)
    assert np.allclose(L.word_logs(index, logs, words), want[0], rtol=1e-10)
    assert np.allclose(L.expected_counts(index, logs, words, counts, lang), want[1], rtol=1e-8)


def test_a_very_long_word_is_quick_and_not_cut():
    pieces = ["▁", "a", "b", "ab"]
    logs = np.log(np.array([[0.1, 0.1], [0.4, 0.2], [0.4, 0.2], [0.1, 0.5]]))
    word = "ab" * 50_000
    assert L.letter_words(f"1 {word}. x") == [word, "x"]
    got = L.word_logs(L.Pieces(pieces), logs, [word])[0]
    p = np.exp(logs)
    assert np.allclose(got, np.log(p[0]) + 50_000 * np.log(p[1] * p[2] + p[3]), rtol=1e-9)
    counts = L.expected_counts(L.Pieces(pieces), logs, [word], np.ones(1), np.zeros(1, int))[:, 0]
    assert np.allclose(counts[[0, 3]], [1, 50_000 * 0.1 / 0.26])
