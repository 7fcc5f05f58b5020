"""Byte-level BPE by speculation: longest matches are proposed, neighbouring tokens checked, failing words merged exactly.

A token sequence is the BPE encoding of a word exactly if every adjacent pair of it is stable, that is, if no merge
across the pair's border comes before the merges inside its two tokens. So one table look-up for each pair on the
inner borders of the tokens' merge trees decides a proposal, and all proposals of a batch are decided together.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from typing import ClassVar

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, chunks, offsets, ranges

#: Known words are forgotten beyond this many, so a worker's memory stays bounded.
WORDS_KEPT = 400_000
#: Words of more bytes are merged and walked one by one, so that their cost grows with n log n.
LONG_WORD = 256
#: Masks for the first n of eight bytes.
KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
FAR = np.int32(1 << 30)


def byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Lookup:
    """An open-addressed table from whole numbers to whole numbers, read for many keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(4 * len(keys)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.mask = size - 1
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = np.flatnonzero(self.keys[at] < 0)
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.keys[at[put]], self.values[at[put]] = keys[left[put]], values[left[put]]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, at = left[rest], (at[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        shape, keys = keys.shape, keys.ravel()
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        at = at[open_]
        while len(open_):
            at = (at + 1) & self.mask
            found = self.keys[at]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[hit]]
            more = ~hit & (found >= 0)
            open_, at = open_[more], at[more]
        return out.reshape(shape)


@dataclass
class Vocabulary:
    """Arrays made from a tokenizer's JSON, small enough to be broadcast."""

    token_bytes: np.ndarray  # all tokens' bytes
    token_at: np.ndarray  # where each token's bytes begin, and the end
    merged: np.ndarray  # rank -> id
    trie: Lookup  # node * 256 + byte -> node
    trie_token: np.ndarray  # node -> id or -1
    spine_left: tuple[np.ndarray, np.ndarray]  # ids on the left border of a token's tree, and the rank that ends each
    spine_right: tuple[np.ndarray, np.ndarray]
    pairs: Lookup  # left id * size + right id -> rank
    specials: dict[str, int]
    byte_ids: np.ndarray
    rank_of: dict[int, int] | None = None

    def __getstate__(self):
        return self.__dict__ | {"rank_of": None}

    @classmethod
    def read(cls, text: str) -> Vocabulary:
        spec = json.loads(text)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *specials.values()]) + 1
        raw = [b""] * size
        for token, i in vocab.items():
            raw[i] = bytes(letters[c] for c in token) if token not in specials else token.encode()
        for token, i in specials.items():
            raw[i] = token.encode()
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        pairs = [(vocab[a], vocab[b]) for a, b in merges]
        ranks = {}
        for rank, pair in enumerate(pairs):
            ranks.setdefault(pair, rank)
        merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        made: dict[int, int] = {}
        for rank, i in enumerate(merged.tolist()):
            made.setdefault(i, rank)
        byte_ids = np.zeros(256, np.int64)
        for letter, b in letters.items():
            byte_ids[b] = vocab[letter]
        keys = np.array([a * size + b for a, b in ranks], np.int64)
        none = np.zeros(0, np.int64)
        out = cls(
            token_bytes=np.frombuffer(b"".join(raw), np.uint8), token_at=offsets([len(x) for x in raw]), merged=merged,
            trie=Lookup(none, none), trie_token=none, spine_left=cls._spines(size, pairs, made, 0), spine_right=cls._spines(size, pairs, made, 1),
            pairs=Lookup(keys, np.array(list(ranks.values()), np.int64)), specials=specials, byte_ids=byte_ids,
        )
        # only tokens that their own bytes lead to may be proposed
        listed = sorted(set(vocab.values()))
        whole = [i for i, ids in zip(listed, out.merge([raw[i] for i in listed]), strict=True) if ids == [i]]
        nodes: dict[int, int] = {}
        ends = [-1]
        for i in whole:
            node = 0
            for b in raw[i]:
                key = node << 8 | b
                if key not in nodes:
                    nodes[key] = len(ends)
                    ends.append(-1)
                node = nodes[key]
            ends[node] = i
        out.trie = Lookup(np.array(list(nodes), np.int64), np.array(list(nodes.values()), np.int64))
        out.trie_token = np.array(ends, np.int64)
        return out

    @staticmethod
    def _spines(size: int, pairs: list[tuple[int, int]], made: dict[int, int], side: int) -> tuple[np.ndarray, np.ndarray]:
        lists = []
        for i in range(size):
            ids, ends, end, at = [], [], int(FAR), i
            while True:
                ids.append(at)
                ends.append(end)
                if at not in made:
                    break
                end = made[at]
                at = pairs[end][side]
            lists.append((ids, ends))
        deep = max(len(x) for x, _ in lists)
        ids, ends = np.full((size, deep), -1, np.int32), np.zeros((size, deep), np.int64)
        for i, (a, b) in enumerate(lists):
            ids[i, : len(a)], ends[i, : len(b)] = a, b
        return ids, ends

    def merge(self, words: Sequence[bytes]) -> list[list[int]]:
        """Exact BPE of some words: in each the lowest rank first, the leftmost of equals, all words in step."""
        out: list[list[int]] = [[] for _ in words]
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        while order and len(words[order[-1]]) > LONG_WORD:
            k = order.pop()
            out[k] = self._merge_long(words[k])
        start = 0
        while start < len(order):
            stop = start + 1
            while stop < len(order) and (stop + 1 - start) * len(words[order[stop]]) <= 1 << 17:
                stop += 1
            group = order[start:stop]
            for k, ids in zip(group, self._merge_group([words[k] for k in group]), strict=True):
                out[k] = ids
            start = stop
        return out

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of ids, FAR where there is none or an id is missing."""
        rank = self.pairs.get(left.astype(np.int64) * (len(self.token_at) - 1) + right)
        return np.where((rank >= 0) & (left >= 0) & (right >= 0), rank, FAR)

    def ranks(self) -> dict[int, int]:
        """The pairs' ranks for one look-up at a time."""
        if self.rank_of is None:
            used = self.pairs.keys >= 0
            self.rank_of = dict(zip(self.pairs.keys[used].tolist(), self.pairs.values[used].tolist(), strict=True))
        return self.rank_of

    def _merge_long(self, word: bytes) -> list[int]:
        """The same for one long word: a heap of ranks and places, and a chain of the tokens that are left."""
        rank_of, merged, size, n = self.ranks(), self.merged.tolist(), len(self.token_at) - 1, len(word)
        first = self.byte_ids[np.frombuffer(word, np.uint8)]
        rank = self._rank(first[:-1], first[1:]).astype(np.int64)
        heap = (rank * (1 << 32) + np.arange(n - 1))[rank < FAR].tolist()
        heapq.heapify(heap)
        ids, rank = first.tolist(), [*rank.tolist(), int(FAR)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        none = int(FAR)
        while heap:
            top = heapq.heappop(heap)
            at, best = top & 0xFFFFFFFF, top >> 32
            if rank[at] != best:
                continue  # one of the two is gone
            gone = after[at]
            ids[at], rank[gone] = merged[best], none
            after[at] = nxt = after[gone]
            if nxt < n:
                before[nxt] = at
                rank[at] = found = rank_of.get(ids[at] * size + ids[nxt], none)
                if found < none:
                    heapq.heappush(heap, found << 32 | at)
            else:
                rank[at] = none
            prev = before[at]
            if prev >= 0:
                rank[prev] = found = rank_of.get(ids[prev] * size + ids[at], none)
                if found < none:
                    heapq.heappush(heap, found << 32 | prev)
        out, at = [], 0
        while at < n:
            out.append(ids[at])
            at = after[at]
        return out

    def _merge_group(self, words: Sequence[bytes]) -> list[list[int]]:
        wide = max(map(len, words))
        if not wide:
            return [[] for _ in words]
        ids = np.full((len(words), wide + 1), -1, np.int32)
        for k, word in enumerate(words):
            ids[k, : len(word)] = self.byte_ids[np.frombuffer(word, np.uint8)]
        rank = np.full(ids.shape, FAR, np.int32)
        rank[:, :-1] = self._rank(ids[:, :-1], ids[:, 1:])
        live = np.arange(len(words))
        column = np.arange(wide + 1)
        while len(live):
            part = rank[live]
            at = part.argmin(1)
            best = part[np.arange(len(live)), at]
            live, at, best = live[best < FAR], at[best < FAR], best[best < FAR]
            if not len(live):
                break
            moved = np.minimum(column + (column > at[:, None]), wide)
            rows = live[:, None]
            ids[live] = ids[rows, moved]
            rank[live] = rank[rows, moved]
            ids[live, at] = self.merged[best]
            rank[live, at] = self._rank(ids[live, at], ids[live, np.minimum(at + 1, wide)])
            back = at > 0
            rank[live[back], at[back] - 1] = self._rank(ids[live[back], at[back] - 1], ids[live[back], at[back]])
        return [row[: n].tolist() for row, n in zip(ids, (ids >= 0).sum(1).tolist(), strict=True)]

    def stable(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether BPE leaves the border between them alone.

        A merge of x, on the right border of the left token's tree, and y, on the left border of the right one's,
        happens if its rank comes before the merge that swallows x (at equal ranks x's own, further left, comes
        first) and not after the one that swallows y.
        """
        ok = np.ones(len(left), bool)
        (xs, x_end), (ys, y_end) = self.spine_right, self.spine_left
        for i in range(xs.shape[1]):
            x = xs[left, i].astype(np.int64)
            live = np.flatnonzero(ok & (x >= 0))
            if not len(live):
                break
            for j in range(ys.shape[1]):
                y = ys[right[live], j].astype(np.int64)
                live, y = live[y >= 0], y[y >= 0]
                if not len(live):
                    break
                rank = self._rank(x[live], y)
                ok[live[(rank < x_end[left[live], i]) & (rank <= y_end[right[live], j]) & (rank < FAR)]] = False
        return ok

    def propose(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest token that starts at each byte and doesn't reach over its word's end (ends: of each byte), by one walk
        down the trie for all bytes together."""
        best, length = np.full(len(data), -1, np.int64), np.ones(len(data), np.int64)
        at = np.arange(len(data))
        node = np.zeros(len(data), np.int64)
        deep = 0
        while len(at):
            node = self.trie.get(node << 8 | data[at + deep]).astype(np.int64)
            at, node = at[node >= 0], node[node >= 0]
            deep += 1
            token = self.trie_token[node]
            hit = token >= 0
            best[at[hit]], length[at[hit]] = token[hit], deep
            inside = at + deep < ends[at]
            at, node = at[inside], node[inside]
        return best, length

    def encode_words(self, words: Sequence[bytes]) -> list[list[int]]:
        """BPE ids of each of some distinct words."""
        out: list[list[int]] = [[] for _ in words]
        sizes = np.array([len(w) for w in words], np.int64)
        bounds = offsets(sizes)
        data = np.frombuffer(b"".join(words), np.uint8)
        best, length = self.propose(data, np.repeat(bounds[1:], sizes))
        steps = []
        for k in np.flatnonzero(sizes > LONG_WORD).tolist():
            a, b = int(bounds[k]), int(bounds[k + 1])
            tokens, far, at, taken = best[a:b].tolist(), length[a:b].tolist(), 0, []
            while at < b - a:
                taken.append(tokens[at])
                at += far[at]
            steps.append((np.full(len(taken), k), np.array(taken, np.int64)))
        active = np.flatnonzero((sizes > 0) & (sizes <= LONG_WORD))
        at = bounds[active]
        while len(active):
            steps.append((active, best[at]))
            at = at + length[at]
            keep = at < bounds[active + 1]
            active, at = active[keep], at[keep]
        if not steps:
            return out
        word, token = np.concatenate([a for a, _ in steps]), np.concatenate([t for _, t in steps])
        order = np.argsort(word, kind="stable")
        word, token = word[order], token[order]
        same = word[1:] == word[:-1]
        left, right = token[:-1][same], token[1:][same]
        size = len(self.token_at) - 1
        pairs, back = np.unique(left * size + right, return_inverse=True)
        fails = ~self.stable(pairs // size, pairs % size)[back]
        wrong = np.zeros(len(words), bool)
        wrong[word[1:][same][fails]] = True
        edges = np.searchsorted(word, np.arange(len(words) + 1))
        flat = token.tolist()
        for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            out[k] = flat[a:b]
        again = np.flatnonzero(wrong).tolist()
        for k, ids in zip(again, self.merge([words[k] for k in again]), strict=True):
            out[k] = ids
        return out


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Of every code point: 0 white space, 1 letter, 2 number, 3 anything else."""
    out = np.full(0x110000, 3, np.uint8)
    low = "".join(map(chr, range(0xD800)))
    high = "".join(map(chr, range(0xE000, 0x110000)))
    for value, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (0, r"\p{White_Space}+")):
        for text, base in ((low, 0), (high, 0xE000)):
            for m in regex.finditer(pattern, text):
                out[base + m.start() : base + m.end()] = value
    return out


def word_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where words begin, as the usual byte-level pattern splits text. first: marks each text's first character."""
    kind = char_classes()[points]
    n = len(points)
    last = np.ones(n, bool)
    last[:-1] = first[1:]
    run = first.copy()
    run[1:] |= kind[1:] != kind[:-1]
    blank = kind == 0
    after_space = np.zeros(n, bool)
    after_space[1:] = (points[:-1] == 32) & ~first[1:]
    before_word = np.zeros(n, bool)
    before_word[:-1] = ~blank[1:] & ~last[:-1]
    starts = np.where(blank, run | before_word, run & ~after_space)
    quotes = np.flatnonzero((points == 39) & starts)
    if len(quotes):
        room = np.flatnonzero(last)
        room = room[np.searchsorted(room, quotes)] - quotes  # characters that follow in the same text
        nxt = lambda k: np.where(room >= k, points[np.minimum(quotes + k, n - 1)], 0)
        a, b = nxt(1), nxt(2)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        size = np.where(one, 2, np.where(two, 3, 0))
        quotes, size, room = quotes[size > 0], size[size > 0], room[size > 0]
        starts[quotes + 1] = False
        ends = (quotes + size)[size <= room]
        starts[ends] = True
    return starts


class Encoder:
    """Encodes whole texts, and remembers the words it has met."""

    held: ClassVar[dict[tuple, Encoder]] = {}

    @classmethod
    def of(cls, key: str, shared, words: Callable | None = None) -> Encoder:
        """The worker's encoder of a broadcast vocabulary, which outlives a task. words: makes another encoder of words."""
        if (key, words) not in cls.held:
            cls.held.clear()
            cls.held[key, words] = cls(shared.value, words and words(shared.value))
        return cls.held[key, words]

    def __init__(self, vocabulary: Vocabulary, encode_words: Callable | None = None):
        self.vocabulary = vocabulary
        self.encode_words = encode_words or vocabulary.encode_words
        self._forget()

    def _forget(self) -> None:
        size = 1 << 21
        self.table = [np.zeros(size, np.uint64), np.zeros(size, np.uint64), np.zeros(size, np.uint8), np.full(size, -1, np.int32)]
        self.long: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after another, and each text's count."""
        special = next(iter(self.vocabulary.specials.items()), None)
        if special and any(special[0] in t for t in texts):
            ids, counts = [], []
            for text in texts:
                parts = text.split(special[0])
                flat, sizes = self._encode(parts)
                bounds = offsets(sizes)
                each = [flat[: bounds[1]]]
                for k in range(1, len(parts)):
                    each += [np.array([special[1]], np.uint32), flat[bounds[k] : bounds[k + 1]]]
                ids.append(np.concatenate(each))
                counts.append(len(ids[-1]))
            return np.concatenate(ids), np.array(counts, np.int64)
        return self._encode(texts)

    def _encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(t) for t in texts], np.int64)
        text = "".join(texts)
        if not text:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        first = np.zeros(len(points) + 1, bool)
        first[offsets(lengths)[:-1]] = True
        first = first[:-1]
        first[0] = True
        starts = word_starts(points, first)
        raw = text.encode()
        data = np.frombuffer(raw, np.uint8)
        if len(data) == len(points):
            at = np.flatnonzero(starts)
            text_of = offsets(lengths)
        else:
            lead = np.flatnonzero((data & 0xC0) != 0x80)
            at = lead[starts]
            text_of = np.concatenate([lead, [len(data)]])[offsets(lengths)]
        ends = np.concatenate([at[1:], [len(data)]])
        word = self._words(raw, at, ends)
        sizes = self.size[word]
        ids = self.flat[ranges(self.at[word], sizes)]
        total = offsets(sizes)
        counts = np.diff(total[np.searchsorted(at, text_of)])
        return ids, counts

    def _words(self, raw: bytes, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number under which each word is known; new words are encoded together.

        Words of up to 16 bytes are found by these bytes themselves, longer ones in a dictionary.
        """
        if len(self.at) > WORDS_KEPT:
            self._forget()
        size = ends - at
        eights = np.ndarray((len(raw) + 1,), "<u8", raw + bytes(16), strides=(1,))
        low = eights[at] & KEEP[np.minimum(size, 8)]
        high = eights[np.minimum(at + 8, len(raw))] & KEEP[np.clip(size - 8, 0, 8)]
        slot = ((low * np.uint64(0x9E3779B97F4A7C15) ^ high * np.uint64(0xC2B2AE3D27D4EB4F) ^ size.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(43)).astype(np.int64)
        short = size <= 16
        out = np.full(len(at), -1, np.int64)
        lows, highs, sizes, numbers = self.table
        left = np.flatnonzero(short)
        k = slot[left]
        while len(left):
            number = numbers[k]
            hit = (lows[k] == low[left]) & (highs[k] == high[left]) & (sizes[k] == size[left]) & (number >= 0)
            out[left[hit]] = number[hit]
            more = ~hit & (number >= 0)
            left, k = left[more], (k[more] + 1) & (len(lows) - 1)
        for j in np.flatnonzero(~short).tolist():
            out[j] = self.long.get(raw[at[j] : ends[j]], -1)
        missing = np.flatnonzero(out < 0)
        if not len(missing):
            return out
        words = [raw[a:b] for a, b in zip(at[missing].tolist(), ends[missing].tolist(), strict=True)]
        number = {}
        one = []
        for j, word in zip(missing.tolist(), words, strict=True):
            if word not in number:
                number[word] = len(self.at) + len(one)
                one.append(j)
        found = self.encode_words(list(number))
        counts = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(counts.sum()))
        out[missing] = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        new = np.array(one, np.int64)
        self.long.update((raw[at[j] : ends[j]], int(out[j])) for j in new[~short[new]].tolist())
        left = new[short[new]]
        k = slot[left]
        while len(left):
            free = np.flatnonzero(numbers[k] < 0)
            put = free[np.unique(k[free], return_index=True)[1]]
            lows[k[put]], highs[k[put]], sizes[k[put]], numbers[k[put]] = low[left[put]], high[left[put]], size[left[put]], out[left[put]]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, k = left[rest], (k[rest] + 1) & (len(lows) - 1)
        self.at = np.concatenate([self.at, self.used + offsets(counts)[:-1]])
        self.size = np.concatenate([self.size, counts])
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(flat)), np.uint32)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        return out

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Each text that runs of ids stand for; bytes that are no UTF-8 become U+FFFD."""
        v = self.vocabulary
        sizes = v.token_at[ids + np.int64(1)] - v.token_at[ids]
        raw = v.token_bytes[ranges(v.token_at[ids], sizes)].tobytes()
        bounds = offsets(sizes)[offsets(counts)].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:], strict=False)]


def share_vocabulary(df: DataFrame, path: str) -> tuple:
    """A vocabulary file's digest and its tables, broadcast; they have a few MB, whatever the input's size."""
    bounded_batches(df)
    with open(path, encoding="utf-8") as f:
        text = f.read()
    return hashlib.sha256(text.encode()).hexdigest(), df.sparkSession.sparkContext.broadcast(Vocabulary.read(text))


def encode_batches(batches: Iterable[pd.DataFrame], shared: tuple) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, Encoder]]:
    """Groups of rows (id, text) with their texts' ids; a null text counts as empty."""
    enc = Encoder.of(*shared)
    for batch in batches:
        texts = batch["text"].fillna("").tolist()
        for a, b in chunks(texts):
            ids, counts = enc.encode(texts[a:b])
            yield batch.iloc[a:b], ids, counts, enc


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and decoded text of each whole document: (id, ids array<int>, decoded string).

    A null text counts as empty and gives no ids. Repeated rows give repeated results. Other columns are not read,
    so their names don't matter. An empty table gives an empty result.
    """
    shared = share_vocabulary(docs, tokenizer)

    def run(batches):
        for rows, ids, counts, enc in encode_batches(batches, shared):
            at = offsets(counts).tolist()
            yield pd.DataFrame({"id": rows["id"].to_numpy(), "ids": [ids[a:b].astype(np.int32) for a, b in zip(at, at[1:], strict=False)], "decoded": enc.decode(ids, counts)})

    narrow = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInPandas(run, "id string, ids array<int>, decoded string").withColumn("id", F.col("id").cast("long")).withColumnRenamed("id", id_col)


def encode_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count and digests of each document's ids and decoded text, made where the ids are, so that ids are not moved.

    A null or empty text has no ids. Whole texts are read, words of any length too. Repeated rows give repeated results,
    rows of a null id keep it, and an empty table gives an empty result. Other columns, of any name, don't matter.
    """
    shared = share_vocabulary(docs, tokenizer)

    def run(batches):
        for rows, ids, counts, enc in encode_batches(batches, shared):
            at = offsets(counts).tolist()
            raw = ids.astype("<u4").tobytes()
            yield pd.DataFrame({
                "id": rows["id"].to_numpy(),
                "n_tokens": counts,
                "ids_sha256": [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(at, at[1:], strict=False)],
                "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in enc.decode(ids, counts)],
            })

    narrow = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInPandas(run, "id string, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumn("id", F.col("id").cast("long")).withColumnRenamed("id", id_col)
