"""An n-gram trie (orders 1 to 3) in Elias-Fano coded, memory-mapped levels.

Level 1 holds the hashes of the words, in order, and their running counts. A level n+1 holds, for
every kept n-gram (its context), the words that follow it: an entry is coded as its
context and a symbol, both as numbers that only grow along the level. The symbol of level 2 is the word's
number; in level 3 it is the position of the last two words among the successors of the
middle word (the context-relative number), which is small. Every level has the pointers of the contexts
into the level, quantised log10 probabilities of the entries and quantised back-off weights of the contexts.

A level is cut into shard files anywhere, also inside the successors of one context, so
no word is too frequent. A look-up sorts the queries, finds their shards by the first key of each and
searches the monotone sequences of those shards.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

from tracewright.llm import blobfile
from tracewright.llm.elias_fano import EliasFano

HASH_BITS = 63
BOW_ONE, BOW_STEP = 204, 0.03


@lru_cache(maxsize=64)
def _file(path: str) -> dict:
    """Arrays and sequences of a shard file."""
    arrays = blobfile.read_arrays(path)
    out = {k: v for k, v in arrays.items() if "/" not in k}
    for name in {k.split("/")[0] for k in arrays if "/" in k}:
        out[name] = EliasFano(blobfile.group(arrays, name))
    return out


def write_shard(path: str, sequences: dict[str, tuple[np.ndarray, int]], **arrays: np.ndarray) -> int:
    packed = dict(arrays)
    for name, (values, bound) in sequences.items():
        packed |= blobfile.prefixed(EliasFano.encode(values, bound), name)
    return blobfile.write_arrays(path, packed)


def _slices(shard: np.ndarray):
    """(shard, start, stop) of the runs of a sorted array of shard numbers."""
    edges = np.flatnonzero(np.diff(shard)) + 1
    for a, b in zip([0, *edges], [*edges, len(shard)]):
        if b > a:
            yield int(shard[a]), a, b


@dataclass
class Vocabulary:
    """Words by hash. Number V is the end of a text; -1 is an unknown word."""
    bits: int                                    # shards are the leading bits of the hash
    shards: list[int] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    first_id: list[int] = field(default_factory=list)
    before: list[int] = field(default_factory=list)      # tokens in the shards before
    words: int = 0
    word_tokens: int = 0
    ends: int = 0

    @property
    def tokens(self) -> int:
        return self.word_tokens + self.ends

    @property
    def types(self) -> int:
        return self.words + (self.ends > 0)

    def log_probability(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1.0) / (self.tokens + self.types + 1.0))

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and counts of words given by their sorted hashes."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        known = {s: i for i, s in enumerate(self.shards)}
        for s, a, b in _slices((hashes >> np.uint64(HASH_BITS - self.bits)).astype(np.int64)):
            if s in known:
                i = known[s]
                f = _file(self.paths[i])
                at = f["hash"].find(hashes[a:b] & np.uint64((1 << (HASH_BITS - self.bits)) - 1))
                on = at >= 0
                ids[a:b] = np.where(on, at + self.first_id[i], -1)
                counts[a:b][on] = self._counts(f, at[on])
        return ids, counts

    @staticmethod
    def _counts(f: dict, at: np.ndarray) -> np.ndarray:
        return (f["cum"].select(at + 1) - f["cum"].select(at)).astype(np.int64)

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of sorted word numbers; the end counts once per text, an unknown word never."""
        out = np.where(ids == self.words, self.ends, 0).astype(np.int64)
        inside = np.flatnonzero((ids >= 0) & (ids < self.words))
        shard = np.searchsorted(np.array(self.first_id + [self.words]), ids[inside], "right") - 1
        for i, a, b in _slices(shard):
            out[inside[a:b]] = self._counts(_file(self.paths[i]), ids[inside[a:b]] - self.first_id[i])
        return out

    def at_mass(self, mass: float) -> tuple[int, int, int]:
        """The word at which the running count passes ``mass``: number, count before it, count."""
        i = max(0, int(np.searchsorted(np.array(self.before, float), mass, "right")) - 1)
        cum = _file(self.paths[i])["cum"]
        j = int(cum.search(np.array([min(max(int(mass) - self.before[i] + 1, 0), int(cum.select(np.array([len(cum) - 1]))[0]))]))[0])
        j = min(max(j - 1, 0), len(cum) - 2)
        low, high = cum.select(np.array([j, j + 1])).astype(np.int64)
        return self.first_id[i] + j, self.before[i] + int(low), int(high - low)


@dataclass
class Level:
    """Order 2 or 3. ``symbols`` bounds the symbols; shard lists are in key order."""
    symbols: int
    step: float                                  # log10 per probability code
    paths: list[str] = field(default_factory=list)
    first_ctx: list[int] = field(default_factory=list)
    first_sym: list[int] = field(default_factory=list)
    last_ctx: list[int] = field(default_factory=list)
    first_pos: list[int] = field(default_factory=list)
    lead: list[int] = field(default_factory=list)        # entries of the first context in earlier shards
    before: list[int] = field(default_factory=list)      # counts in the shards before
    size: int = 0
    total: int = 0

    def find(self, ctx: np.ndarray, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For pairs in ascending order: position (-1 if absent), number among the
        successors of the context, log10 probability, log10 back-off weight of the context."""
        n = len(ctx)
        pos, rel = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        code, bow = np.zeros(n, np.uint8), np.full(n, BOW_ONE, np.uint8)
        if not self.paths or not n:
            return pos, rel, code * -self.step, bow_value(bow)
        firsts, first_sym = np.array(self.first_ctx), np.array(self.first_sym)
        shard = np.searchsorted(firsts, ctx, "right") - 1
        while True:
            late = (shard >= 0) & (firsts[shard] == ctx) & (first_sym[shard] > sym)
            if not late.any():
                break
            shard = shard - late
        following = np.minimum(shard + 1, len(firsts) - 1)
        for k, a, b in _slices(shard):
            c, s = ctx[a:b], sym[a:b]
            if k >= 0:
                f = _file(self.paths[k])
                low, high = self.first_ctx[k], self.last_ctx[k]
                inside = np.flatnonzero(c <= high)
                local = c[inside] - low
                bow[a:b][inside] = f["bow"][local]
                key = (local * self.symbols + s[inside]).astype(np.uint64)
                maybe = np.flatnonzero(in_filter(f["filter"], key))
                at = np.full(len(key), -1, np.int64)
                at[maybe] = f["keys"].find(key[maybe])
                hit = at >= 0
                rows, at, local = inside[hit], at[hit], local[hit]
                pos[a:b][rows] = at + self.first_pos[k]
                code[a:b][rows] = f["prob"][at]
                start = f["ptr"].select(local).astype(np.int64)
                rel[a:b][rows] = at - start + np.where(local == 0, self.lead[k], 0)
            # the successors of a context may begin in the following shard only
            nxt = np.flatnonzero((following[a:b] > k) & (firsts[following[a:b]] == c))
            if len(nxt):
                bow[a:b][nxt] = _file(self.paths[int(following[a])])["bow"][0]
        return pos, rel, code * -self.step, bow_value(bow)

    def back_off(self, ctx: np.ndarray) -> np.ndarray:
        """log10 back-off weights of sorted contexts."""
        bow = np.full(len(ctx), BOW_ONE, np.uint8)
        if self.paths:
            shard = np.searchsorted(np.array(self.first_ctx), ctx, "right") - 1
            for k, a, b in _slices(shard):
                if k >= 0:
                    inside = np.flatnonzero(ctx[a:b] <= self.last_ctx[k])
                    bow[a:b][inside] = _file(self.paths[k])["bow"][ctx[a:b][inside] - self.first_ctx[k]]
        return bow_value(bow)

    def counts(self, pos: np.ndarray) -> np.ndarray:
        """Counts of the entries at sorted positions."""
        out = np.zeros(len(pos), np.int64)
        shard = np.searchsorted(np.array(self.first_pos), pos, "right") - 1
        for k, a, b in _slices(shard):
            cum = _file(self.paths[k])["cum"]
            at = pos[a:b] - self.first_pos[k]
            out[a:b] = (cum.select(at + 1) - cum.select(at)).astype(np.int64)
        return out

    def at_mass(self, mass: float) -> tuple[int, int, int]:
        """The entry at which the running count passes ``mass``: position, count before it, count."""
        k = max(0, int(np.searchsorted(np.array(self.before, float), mass, "right")) - 1)
        cum = _file(self.paths[k])["cum"]
        most = int(cum.select(np.array([len(cum) - 1]))[0])
        j = int(cum.search(np.array([min(max(int(mass) - self.before[k] + 1, 0), most)]))[0])
        j = min(max(j - 1, 0), len(cum) - 2)
        low, high = cum.select(np.array([j, j + 1])).astype(np.int64)
        return self.first_pos[k] + j, self.before[k] + int(low), int(high - low)


def make_filter(keys: np.ndarray) -> np.ndarray:
    """One bit in 8 to 16 a key, at a hash of it: most keys that are not there are refused at once."""
    bits = max(3, int(8 * len(keys) - 1).bit_length())
    marks = np.zeros(1 << bits, np.uint8)
    marks[_filter_place(keys, bits)] = 1
    return np.packbits(marks, bitorder="little")


def in_filter(marks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = _filter_place(keys, 3 + int(len(marks) - 1).bit_length())
    return (marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1


def _filter_place(keys: np.ndarray, bits: int) -> np.ndarray:
    mixed = (keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def bow_value(code: np.ndarray) -> np.ndarray:
    return (code.astype(np.int64) - BOW_ONE) * BOW_STEP


def bow_code(value: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(value / BOW_STEP) + BOW_ONE, 0, 255).astype(np.uint8)


def probability_code(value: np.ndarray, step: float) -> np.ndarray:
    return np.clip(np.rint(-value / step), 0, 255).astype(np.uint8)
