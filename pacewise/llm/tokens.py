"""Token counts of a byte-fallback BPE piece model by rank-synchronous merging of ragged numpy arrays.

A text becomes pre-tokens: white-space marks with the characters up to the next mark, and
a line break by itself, since no piece crosses these borders (checked when the model is
read). All pre-tokens of a batch lie in one flat array of symbols. A round finds the
lowest-ranked pair of every pre-token and applies it in all of them at once, until no pair is
left; the symbols that survive are counted, a character without a piece as its UTF-8 bytes.

A long pre-token would need a round over all its symbols for every merge of its own. From ``LONG_SYMBOLS`` on its
pairs therefore wait in a queue by rank and place, over linked symbols, so its work grows with its length and not with
the square of it. Such a pre-token takes about 60 bytes of memory a character.

Equal pairs of a pre-token merge from the left, without overlap. Where such a round would
create a pair ranked no later than the one applied, only the leftmost is merged in that
pre-token, which is the order the model defines.

Defined cases. A null or empty text has 0 tokens and 0 bytes. Strings that look like special
tokens are ordinary text. Other columns are ignored; repeated rows give repeated results.
"""

from __future__ import annotations

import heapq
import re
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
MEMO_ENTRIES = 300_000   # pre-tokens whose counts a task remembers
ROUND_SYMBOLS = 1 << 20  # symbols merged together
LONG_SYMBOLS = 512       # a pre-token from here on is merged by a queue of its pairs
LIMIT = 4096

_NONE = np.int64(1) << 40
_UNITS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Merger:
    """The merge table of a model, and the rounds over it."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.vocab_size())
               if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = {model.id_to_piece(i): i for i in ids}
        scores = {i: model.get_score(i) for i in ids}
        if any(MARK in p.lstrip(MARK) for p in pieces) or any("\n" in p for p in pieces):
            raise ValueError("a piece of this model crosses the borders of pre-tokens")
        if model.normalize("Aéﬁ b") != f"{MARK}Aéﬁ{MARK}b" or model.normalize(" ") != MARK * 2:
            raise ValueError("only models that leave the text as it is are supported")
        ranked = sorted(set(scores.values()), reverse=True)
        rank_of = {s: r for r, s in enumerate(ranked)}
        self.characters = {p: i for p, i in pieces.items() if len(p) == 1}
        pairs = {}
        for piece, i in pieces.items():
            for cut in range(1, len(piece)):
                left, right = pieces.get(piece[:cut]), pieces.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left << 24 | right] = (rank_of[scores[i]], i)
        self.pairs = pairs
        self._table(pairs)
        self.codes = np.full(0x110000, -1, np.int32)
        for p, i in self.characters.items():
            self.codes[ord(p)] = i
        if MARK not in self.characters:
            raise ValueError("the model has no piece for white space")

    def _table(self, pairs: dict) -> None:
        """An open-addressing table of pairs, probed for whole arrays."""
        bits = max(10, (4 * len(pairs)).bit_length())
        self._shift, mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys = np.full(1 << bits, -1, np.int64)
        self._rank = np.full(1 << bits, _NONE, np.int64)
        self._made = np.zeros(1 << bits, np.int32)
        keys = np.fromiter(pairs, np.int64, len(pairs))
        for key, slot in zip(keys.tolist(), self._slots(keys).tolist()):
            while self._keys[slot] >= 0:
                slot = (slot + 1) & mask
            self._keys[slot] = key
            self._rank[slot], self._made[slot] = pairs[key]

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slots of pairs; a slot that holds no pair where there is none."""
        keys = left.astype(np.int64) << 24 | right
        keys[(left < 0) | (right < 0)] = -2
        slots = self._slots(keys)
        open_at = np.flatnonzero((self._keys[slots] != keys) & (self._keys[slots] != -1))
        mask = len(self._keys) - 1
        while len(open_at):
            slots[open_at] = (slots[open_at] + 1) & mask
            held = self._keys[slots[open_at]]
            open_at = open_at[(held != keys[open_at]) & (held != -1)]
        return slots

    def counts(self, units: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        out = np.zeros(len(units), np.int64)
        short = np.flatnonzero(sizes < LONG_SYMBOLS)
        ends, first = np.cumsum(sizes[short]), 0
        while first < len(short):
            done = ends[first - 1] if first else 0
            end = max(first + 1, int(np.searchsorted(ends, done + ROUND_SYMBOLS, "right")))
            some = short[first:end]
            out[some] = self._merge("".join([units[i] for i in some]), sizes[some])
            first = end
        for i in np.flatnonzero(sizes >= LONG_SYMBOLS):
            out[i] = self._merge_long(units[i])
        return out

    def _merge_long(self, text: str) -> int:
        """Tokens of one pre-token: its pairs by rank, equal ones from the left, each looked up when it appears."""
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n, codes = len(code), self.codes[code]
        weight = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
        tokens = int(np.where(codes < 0, weight, 1).sum())
        rank, _ = self._ranks(codes, np.zeros(n, np.int8))
        at = np.flatnonzero(rank < _NONE)
        waiting = np.sort(rank[at] << 32 | at).tolist()  # sorted, so a heap
        # place n stands for both ends; it and symbols that were merged away are part of no pair
        symbols = array("i", np.r_[codes, -1].astype(np.int32).tobytes())
        after = array("i", np.r_[np.arange(1, n + 1), n].astype(np.int32).tobytes())
        before = array("i", np.r_[n, np.arange(n)].astype(np.int32).tobytes())
        pairs = self.pairs
        while waiting:
            first = heapq.heappop(waiting)
            place = first & 0xFFFFFFFF
            other = after[place]
            left, right = symbols[place], symbols[other]
            found = pairs.get(left << 24 | right) if left >= 0 and right >= 0 else None
            if found is None or found[0] != first >> 32:
                continue  # a merge beside it came first
            made = found[1]
            symbols[place], symbols[other] = made, -1
            beyond = after[place] = after[other]
            if beyond < n:
                before[beyond] = place
                if symbols[beyond] >= 0 and (found := pairs.get(made << 24 | symbols[beyond])):
                    heapq.heappush(waiting, found[0] << 32 | place)
            left = before[place]
            if left < n and symbols[left] >= 0 and (found := pairs.get(symbols[left] << 24 | made)):
                heapq.heappush(waiting, found[0] << 32 | left)
            tokens -= 1
        return tokens

    def _merge(self, text: str, sizes: np.ndarray) -> np.ndarray:
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self.codes[code]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        # a character without a piece never merges; it counts as its bytes
        weight = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
        out = np.bincount(owner, np.where(symbols < 0, weight, 1), len(sizes)).astype(np.int64)
        rank, made = self._ranks(symbols, owner)
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(owner)]))
            live = lowest < _NONE
            if not live.all():  # pre-tokens without a pair are done
                symbols, owner, rank, made, lowest = (x[live] for x in (symbols, owner, rank, made, lowest))
                if not len(symbols):
                    break
            hit = rank == lowest
            if hit.any():
                # of neighbouring hits every second one, from the left
                at = np.flatnonzero(hit)
                run = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])])
                place = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
                at = at[place % 2 == 0]
                merged = self._applied(symbols, owner, made, at)
                new_rank, new_made = self._ranks(merged[0], merged[1])
                fresh = np.flatnonzero(merged[2])
                near = np.unique(np.r_[fresh, fresh[fresh > 0] - 1])
                early = near[new_rank[near] <= lowest[merged[3][near]]]
                if len(early):
                    many = np.bincount(owner[at], minlength=len(sizes)) > 1
                    bad = np.zeros(len(sizes), bool)
                    bad[merged[1][early]] = True
                    bad &= many
                    if bad.any():
                        leading = np.r_[True, owner[at[1:]] != owner[at[:-1]]]
                        at = at[~bad[owner[at]] | leading]
                        merged = self._applied(symbols, owner, made, at)
                        new_rank, new_made = self._ranks(merged[0], merged[1])
                out -= np.bincount(owner[at], minlength=len(sizes))
                symbols, owner, rank, made = merged[0], merged[1], new_rank, new_made
        return out

    def _applied(self, symbols, owner, made, at):
        """Symbols after merging the pairs at ``at``; also what is new, and where each came from."""
        after, new = symbols.copy(), np.zeros(len(symbols), bool)
        after[at], new[at] = made[at], True
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        came = np.flatnonzero(keep)
        return after[came], owner[came], new[came], came

    def _ranks(self, symbols, owner):
        rank = np.full(len(symbols), _NONE)
        made = np.zeros(len(symbols), np.int32)
        if len(symbols) > 1:
            slots = self._find(symbols[:-1], symbols[1:])
            rank[:-1] = np.where(owner[1:] == owner[:-1], self._rank[slots], _NONE)
            made[:-1] = self._made[slots]
        return rank, made


@cache
def merger(path: str) -> Merger:
    return Merger(path)


def _lines(text: str):
    """Pre-tokens of a text and the number of its line breaks."""
    lines = (MARK + text.replace(" ", MARK)).split("\n")
    units: list[str] = []
    for line in lines:
        if MARK * 2 in line:
            units += _UNITS.findall(line)
        else:
            head, *rest = line.split(MARK)
            if head:
                units.append(head)
            if rest:
                units += [MARK + w for w in rest]
    return units, len(lines) - 1


def counted(texts, path: str, memo: dict[str, int]) -> list[int]:
    """Tokens of each text. ``memo`` keeps counts of pre-tokens between calls."""
    model = merger(path)
    if len(memo) > MEMO_ENTRIES:
        memo.clear()
    split = [_lines(t) if t else ([], 0) for t in texts]
    unseen = list({u for units, _ in split for u in units if u not in memo})
    fresh = dict(zip(unseen, model.counts(unseen).tolist())) if unseen else {}
    memo.update(fresh)
    return [sum(map(memo.__getitem__, units)) + breaks for units, breaks in split]


def _counting(path: str, chunk: int = 1 << 20):
    def run(batches):
        memo: dict[str, int] = {}
        for batch in batches:
            sizes, tokens, held, length = [], [], [], 0
            for value in batch.column(1):
                text = value.as_py() or ""
                sizes.append(len(text.encode()))
                held.append(text)
                length += len(text)
                if length > chunk:
                    tokens += counted(held, path, memo)
                    held, length = [], 0
            tokens += counted(held, path, memo)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens"])
    return run


def token_counts(documents: DataFrame, model_path: str, limit: int = LIMIT, id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for every row. Every executor reads the model from ``model_path``."""
    return (documents.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
            .mapInArrow(_counting(model_path), "doc_id long, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))
