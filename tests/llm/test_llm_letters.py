"""Languages of many letters: none is cut from the model."""

import math
import random

import pytest
from test_llm_learned import plain_phrases

from leakscan.llm import language


def scripts():
    rnd = random.Random(11)
    ranges = {"zh": (0x4E00, 900), "ko": (0xAC00, 600), "ja": (0x3041, 80), "hy": (0x561, 38), "ka": (0x10D0, 33), "en": (0x61, 26)}
    letters = {name: [chr(first + i) for i in range(n)] for name, (first, n) in ranges.items()}
    vocabulary = {n: ["".join(rnd.choice(own) for _ in range(rnd.randint(1, 5))) for _ in range(400)] for n, own in letters.items()}

    def text(name, size):
        return " ".join(rnd.choice(vocabulary[name]) for _ in range(size))

    samples = [("en", text("en", 4000)), *[(n, text(n, 300)) for n in letters if n != "en"]]
    return samples, [(n, text(n, 40)) for n in letters]


def test_languages_of_many_letters_are_told_apart():
    samples, texts = scripts()
    model = language.train(samples)
    assert set(model.languages) == {n for n, _ in samples}
    assert set(model.letters) == {c for _, t in samples for c in t.lower() if c.isalpha()}
    names, _ = language.Parser(model).predict([t for _, t in texts])
    assert names == [n for n, _ in texts]


def test_phrases_of_letters_beyond_the_table():
    rnd = random.Random(12)
    han = [chr(0x4E00 + i) for i in range(300)]
    known = [("a", "".join(rnd.choice([*han, " "]) for _ in range(400))), ("b", "".join(rnd.choice("abc ") for _ in range(300)))]
    model = language.train(known)
    texts = ["", known[0][1][50:90] + "ab", "".join(rnd.choice([*han, *"abcd "]) for _ in range(1100)), "\u4dff" * 3]
    costs, _ = language.Parser(model).costs(texts)
    for k, (_, text) in enumerate(known):
        symbols = [*language.Reader(model.letters).symbols(text)[0].tolist(), language.UNKNOWN]
        for t, cost in zip(texts, costs[:, k]):
            phrases, size = plain_phrases(t, symbols, model)
            assert cost == pytest.approx(phrases * math.log2(len(symbols)) / max(size, 1))
