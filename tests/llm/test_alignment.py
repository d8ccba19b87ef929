"""Alignment of two tokenizers against a plain count of all links."""

import hashlib
import json
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pacewise.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
FILES = A, B, public_tokenizers.PATTERN
BITS = ["the", " the", " a", "ing", " ", "  ", "\n", "\t", "é", "日本", "!", "123", " Straße", "😀", "x\x00y", " don't", "<s>", "<|endoftext|>", "\r\n"]


def made(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(1, 60))) for _ in range(n)]


def plain(texts):
    """Per text (a ids, b ids, groups), by the libraries and a walk over both lists."""
    a_model, b_model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_model.encode_special_tokens = True
    pair = alignment.aligner(*FILES)
    out = []
    for text in texts:
        if not text:
            out.append(([], [], []))
            continue
        a, b = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)
        want = (" " + text).encode()
        if b"".join(pair.bytes_a[i] for i in a) != want or b"".join(pair.bytes_b[i] for i in b) != want:
            out.append(([], [], []))
            continue
        groups, i, j, end_a, end_b, left, right = [], 0, 0, 0, 0, [], []
        while i < len(a) or j < len(b):
            if end_a <= end_b and i < len(a):
                left.append(a[i])
                end_a += len(pair.bytes_a[a[i]])
                i += 1
            else:
                right.append(b[j])
                end_b += len(pair.bytes_b[b[j]])
                j += 1
            if end_a == end_b and left and right:
                groups.append((left, right))
                left, right = [], []
        out.append((a, b, groups))
    return out


def expected(rows):
    found = plain([t for _, t in rows])
    counts = Counter((l[-1], r[-1]) for _, _, groups in found for l, r in groups)
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for (doc, _), (a, b, groups) in zip(rows, found):
        links = [(l[-1], r[-1]) for l, r in groups]
        text = ";".join(",".join(map(str, l)) + "|" + ",".join(map(str, r)) for l, r in groups)
        out.append((doc, len(a), len(b), len(groups), len(links), sum(counts[k] == best[k[1]] for k in links),
                    sum(counts[k] for k in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return out, counts


ROWS = [*enumerate([None, "", " ", "a", "x▁y", "▁", "two  words", "\n\n", "unbroken" * 900, "日本" * 400, "word " * 4000, *made(1, 150)]),
        (3, "a"), (3, "the the"), (None, "the the"), (None, None)]


@pytest.mark.parametrize("frequent, block", [(alignment.FREQUENT, alignment.BLOCK_CHARACTERS), (40, 64), (0, 200)])
def test_equals_plain_count(docs, frequent, block):
    figures, links = alignment.alignment(docs(ROWS), *FILES, frequent=frequent, block=block)
    want, counts = expected(ROWS)
    assert sorted(map(tuple, figures.collect()), key=str) == sorted(want, key=str)
    assert {(r.a, r.b): r["count"] for r in links.collect()} == dict(counts)


def test_many_pairs_leave_a_task_in_parts(docs, monkeypatch):
    monkeypatch.setattr(alignment, "PAIR_ENTRIES", 50)
    figures, _ = alignment.alignment(docs(ROWS), *FILES)
    assert sorted(map(tuple, figures.collect()), key=str) == sorted(expected(ROWS)[0], key=str)


def test_same_bytes():
    pair = alignment.aligner(*FILES)
    assert all(pair.bytes_b[b] == pair.bytes_a[a] for a, b in enumerate(pair.same) if b >= 0)
    # a character that is a piece is not mapped to its byte
    a = pair.bytes_a.index(b"A")
    assert pair.same[a] > 258 and (pair.same >= 0).sum() > 5000


def test_empty_table(docs):
    figures, links = alignment.alignment(docs([]), *FILES)
    assert figures.collect() == [] and links.collect() == []


def test_pretokens_of_every_character():
    """Neighbours of each character show its class, which must be that of the library."""
    pair, library = alignment.aligner(*FILES), Tokenizer.from_file(A)
    for low in range(0, 0x32000, 0x1000):
        text = "".join(f" a{chr(c)}b {chr(c)}1{chr(c)}2\n{chr(c)}! {chr(c)}!" for c in range(low, low + 0x1000) if not 0xD800 <= c < 0xE000)
        assert np.frombuffer(pair.a(f" {text}"), "<u4").tolist() == library.encode(" " + text, add_special_tokens=False).ids


def test_merges_are_ranks():
    """Each token comes from its own merge, whichever neighbours with its bytes may merge."""
    pair = alignment.aligner(*FILES)
    with open(A, encoding="utf-8") as file:
        model = json.load(file)["model"]
    alphabet = alignment._byte_alphabet()
    ranks = {bytes(alphabet[c] for c in t): i for t, i in model["vocab"].items()}
    for merge in model["merges"]:
        left, right = (bytes(alphabet[c] for c in x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
        token, parts = left + right, [bytes([x]) for x in left + right]
        while len(parts) > 2:
            rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
            assert rank < ranks[token]
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        assert parts == [left, right]
    assert pair.bytes_a[ranks[token]] == token
