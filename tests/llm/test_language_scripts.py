"""Cross-parsing against a plain parser: scripts with many letters, long texts in parts, and the winner."""

import random
import unicodedata
from math import log2

import numpy as np
import pytest

from palimpsest.llm import language_id


def plain_symbols(text):
    out = []
    for c in text.lower():
        c = c if unicodedata.category(c)[0] == "L" else " "
        if c != " " or not out or out[-1] != " ":
            out.append(c)
    return "".join(out)


def plain_phrases(train, text):
    n = 0
    for k in range(0, len(text), language_id.LANE):
        part, at = text[k : k + language_id.LANE], 0
        while at < len(part):
            size = 1
            while at + size < len(part) and part[at : at + size + 1] in train:
                size += 1
            n, at = n + 1, at + size
    return n


def alphabet(first, n):
    return [chr(first + i) for i in range(n)]


def prose(r, letters, n):
    words = ["".join(r.choices(letters, k=r.randint(1, 4))) for _ in range(60)]
    return " ".join(r.choices(words, k=n))


@pytest.fixture(scope="module")
def corpora():
    r = random.Random(2)
    kinds = {
        "han_a": alphabet(0x4E00, 300),
        "han_b": alphabet(0x5E00, 300),
        "kana": alphabet(0x3041, 80),
        "ru": alphabet(0x430, 32),
        "bg": alphabet(0x430, 32),
        "en": alphabet(0x61, 26),
    }
    out = {}
    for lang, letters in kinds.items():
        words = ["".join(r.choices(letters, k=r.randint(1, 5))) for _ in range(400)]
        out[lang] = [" ".join(r.choices(words, k=r.randint(3, 80))) for _ in range(60)]
    return out


@pytest.mark.parametrize("dense", [language_id.DENSE, 2])
def test_many_scripts(corpora, monkeypatch, dense):
    monkeypatch.setattr(language_id, "DENSE", dense)
    parser = language_id.CrossParser({k: "\n".join(v[:40]) for k, v in corpora.items()})
    for lang, texts in corpora.items():
        assert [g[0] for g in parser.predict(texts[40:])] == [lang] * 20


@pytest.mark.parametrize("dense", [language_id.DENSE, 2])
def test_phrases_and_winner_are_those_of_a_plain_parse(corpora, monkeypatch, dense):
    monkeypatch.setattr(language_id, "DENSE", dense)
    train = {k: "\n".join(v[:6]) for k, v in corpora.items()}
    texts = [v[50][:60] for v in corpora.values()] + [corpora["ru"][51] + " 漢字 " + corpora["en"][3], "ß ǅ 1", "한글"]
    texts += [" ".join(corpora["ru"][41:50] + corpora["bg"][41:50] + corpora["en"][41:45])]  # more than one part
    assert len(plain_symbols(texts[-1])) > 2 * language_id.LANE
    parser = language_id.CrossParser(train)
    got = parser.predict(texts)
    for text, (lang, score) in zip(texts, got, strict=True):
        cost = {}
        for k, t in train.items():
            own = plain_symbols(t)
            cost[k] = plain_phrases(own, plain_symbols(text)) * log2(len(own))
        best = min(sorted(cost), key=cost.get)
        rest = min(v for k, v in cost.items() if k != best)
        assert lang == best and abs(score - (1 - cost[best] / rest)) < 1e-9


def test_long_texts_fill_several_grids(monkeypatch, corpora):
    train = {k: "\n".join(v[:6]) for k, v in corpora.items()}
    parser = language_id.CrossParser(train)
    text = " ".join(t for v in corpora.values() for t in v)
    whole = parser.predict([text, None, "12", text])
    monkeypatch.setattr(language_id, "BLOCK", 2 * language_id.LANE)
    assert parser.predict([text, None, "12", text]) == whole
    assert whole[1] == whole[2] == ("und", 0.0) and whole[0] == whole[3]


def test_codes_of_letters():
    parser = language_id.CrossParser({"x": "ab"})
    assert np.array_equal(parser.symbols("aZ,  b9"), [2, 1, 0, 3, 0])
