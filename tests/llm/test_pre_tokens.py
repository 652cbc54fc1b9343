"""Pre-tokens of plain texts are split without the library, and give the library's ids."""

import random

import numpy as np
from tokenizers import Tokenizer

from palimpsest.llm import tokens
from palimpsest.llm.queries import tokenizer_path


def test_letters_and_marks_are_known_apart():
    assert tokens._chunks("Athahe athahe, ATHAHE%%% 42é") == ["athahe", "athahe", ",", "athahe", "%%%", "4", "2", "é"]
    assert tokens._chunks("it's Ok. ok…") == ["it's", "ok", ".", "ok…"]
    assert tokens._chunks("a<|endoftext|>b A|b") == ["a<|endoftext|>b", "a", "|", "b"]


def test_ids_are_the_librarys():
    path = tokenizer_path("word_bpe_49k.json")
    tk = Tokenizer.from_file(path)
    r = random.Random(9)
    parts = ["a", "Z", "ß", "É", "ÿ", "×", "÷", "ª", "µ", "²", "7", "'", "'s", "'LL", "<", "|", ">", "<|", "|>", "<|endoftext|>", "</w>", "w", "\\", "]", "^", "-", "%%%", ".!!", " ", " ", "\n", "\r", "\t", "\x0b", "\x1c", "\x85", "\xa0", "\xad", "é", "́", "İ", "…", "“", "中", "\x01", "\0", "hello", "THE", "@x", "_y"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(24))) for _ in range(6000)]
    got = [b for at in range(0, len(texts), 500) for b in tokens.ids_block(path, texts[at : at + 500])]
    want = [np.array(e.ids, "<u4").tobytes() for e in tk.encode_batch_fast(texts, add_special_tokens=False)]
    assert [t for t, a, b in zip(texts, got, want, strict=True) if a != b] == []
