"""Token ids of whole texts inside Arrow batches."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
from tokenizers import Tokenizer, normalizers, pre_tokenizers

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")       # Spark runs the tasks side by side

MEMO_WORDS = 1_000_000
MEMO_LENGTH = 64
CHUNK_CHARS = 1 << 20
LEARN_WORDS = 512
_SIGNS = "#*$%&!?.,;:"
_LETTERS = re.compile("[" + "".join(c for c in map(chr, range(ord("İ"))) if c.isalpha() and c.islower()) + "]+")


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes, for a vocabulary whose pre-tokenizer
    separates letters, digits, blanks and other signs, that has no capitals, and that marks word ends with ``</w>``.

    No token reaches across a blank, so a text is cut at blanks and line ends, and the ids of
    short words are remembered. The memory is only a cache: it is emptied when full,
    and results do not depend on it.
    """

    def __init__(self, path: str):
        self._tokenizer = Tokenizer.from_file(path)
        self._memo: dict[str, bytes] = {"": b""}
        # for words of small Latin letters, which need no normal form and are one pre-token each
        self._plain = Tokenizer.from_file(path)
        self._plain.normalizer = normalizers.Sequence([])
        self._plain.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    @property
    def largest(self) -> int:
        """The largest id of the vocabulary."""
        return len(self._ends) - 1

    def _coded(self, pieces: list[str]) -> list[bytes]:
        return [array("I", c.ids).tobytes()
                for c in self._tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _letters(self, bodies: list[str]) -> list[bytes]:
        """Words of plain letters, some hundred at once as one text that is cut after each word end."""
        if len(bodies) > LEARN_WORDS:
            return [x for i in range(0, len(bodies), LEARN_WORDS) for x in self._letters(bodies[i:i + LEARN_WORDS])]
        coded = self._plain.encode_batch_fast([" ".join(bodies)], add_special_tokens=False)[0].ids
        ids = np.array(coded, "<u4")
        ends = np.flatnonzero(self._ends[ids]) + 1
        if len(ends) != len(bodies):              # a vocabulary with other rules
            return self._coded(bodies)
        raw, out, a = ids.tobytes(), [], 0
        for b in (4 * ends).tolist():
            out.append(raw[a:b])
            a = b
        return out

    def _learn(self, pieces: Iterable[str]) -> None:
        """Remember the ids of new pieces. Signs after plain letters are a token of their own."""
        memo = self._memo
        other, signed, bodies = [], [], set()
        for w in pieces:
            body = w.rstrip(_SIGNS)
            if not _LETTERS.fullmatch(body):
                other.append(w)
                continue
            if len(body) < len(w):
                signed.append(w)
            if body not in memo:
                bodies.add(body)
        if bodies:
            bodies = list(bodies)
            memo.update(zip(bodies, self._letters(bodies)))
        ends = {w[len(w.rstrip(_SIGNS)):] for w in signed}.difference(memo, other)
        whole = [*other, *ends]
        memo.update(zip(whole, self._coded(whole)))
        for w in signed:
            body = w.rstrip(_SIGNS)
            memo[w] = memo[body] + memo[w[len(body):]]

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of every text in turn; null counts as empty."""
        held: list[list[str]] = []
        size = 0
        for text in texts:
            held.append(_lowered(text or "").replace("\n", " ").split(" "))
            size += len(text or "")
            if size >= CHUNK_CHARS:
                yield from self._chunk(held)
                held, size = [], 0
        yield from self._chunk(held)

    def _chunk(self, held: list[list[str]]) -> Iterator[bytes]:
        if len(self._memo) > MEMO_WORDS:
            self._memo = {"": b""}
        seen: set[str] = set()
        for pieces in held:
            seen.update(pieces)
        new = seen.difference(self._memo)
        if new:
            self._learn(new)
        for pieces in held:
            yield b"".join(map(self._memo.__getitem__, pieces))
        for w in [w for w in new if len(w) > MEMO_LENGTH]:
            del self._memo[w]


def _lowered(text: str) -> str:
    """Small letters where that is certain to be what the vocabulary's rule gives: in Latin-1 texts."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text if "<|" in text else text.lower()          # special tokens are matched before


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
