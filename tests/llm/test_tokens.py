"""Token counts against the library."""

import random

import public_tokenizers
import sentencepiece

from pacewise.llm import tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a b", " a  b ", "a\nb", "\n\n \n", "a\tb", "<s>x</s> <unk> <0x0A>", "é日本　x", "ﬁ ﬁ", "▁a ▁", "a\x00b", "\r\n x\r\n",
       "a" * 3000, "abab" * 700, "!?!?!!" * 300, "😀😀 x😀", "      x       y    ", "hahahaha" * 200 + " " * 100, "=" * 777, "é"]


def library(texts):
    return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=PATH).encode(texts, num_threads=1)]


def made(seed, n):
    rng = random.Random(seed)
    bits = ["a", "b", "th", "e", "in", "er", " ", "  ", "\n", "é", "日", "!", "=", "▁", "0", "ing", " the", "\r", "x", "😀"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(1, 80))) for _ in range(n)]


def test_equals_library():
    texts = ODD + made(4, 2000)
    assert tokens.counted(texts, PATH, {}) == library(texts)


def test_memo_does_not_matter(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_ENTRIES", 10)
    monkeypatch.setattr(tokens, "ROUND_SYMBOLS", 64)
    texts, memo = made(5, 300), {}
    got = [n for i in range(0, 300, 7) for n in tokens.counted(texts[i:i + 7], PATH, memo)]
    assert got == library(texts)


def test_table(docs):
    texts = [None, *ODD, "word " * 5000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "x y"), (3, "a b")]
    got = tokens.token_counts(docs(rows), PATH).collect()
    assert len(got) == len(rows)
    want = library([t or "" for t in texts])
    for r in got:
        if r.doc_id is not None and r.doc_id != 3:
            text = texts[r.doc_id] or ""
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), want[r.doc_id], want[r.doc_id] > 4096)
    assert tokens.token_counts(docs([]), PATH).collect() == []


def test_long_unbroken_texts():
    """Long pre-tokens against the library; the last one would take minutes by rounds over all its symbols."""
    rng = random.Random(6)
    alphabets = ["ab", "aaab", "the", "0123", "ertion", "é中a=", "abcdefghijklmnopqrstuvwxyz", "=-"]
    texts = [" ".join("".join(rng.choice(a) for _ in range(rng.randint(tokens.LONG_SYMBOLS - 5, 1500))) for _ in range(3))
             for a in alphabets for _ in range(8)]
    texts += ["the" * 3001 + "é中" * 500 + "😀" * 700, "ound" * 20_000, "".join(rng.choice("ABCDEFabcdef0123456789+/") for _ in range(150_000)),
              "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300_000))]
    assert tokens.counted(texts, PATH, {}) == library(texts)
