"""Token ids of whole texts, with each distinct run of characters tokenized once.

The vocabulary splits text at white space, between letters, digits and other characters, and
folds case, so the ids of a text are those of its runs in order.  Runs are found and hashed as
bytes; only runs that a worker has not met yet go to the tokenizer, joined by a control
character that is a token of its own.  Runs with characters whose rules depend on neighbours
(apostrophes, marks beyond Latin letters, spellings of special tokens) stay whole up to the
next white space.
"""

from __future__ import annotations

import os

import numpy as np

from fleetsight.llm import bytetext as B

_SPACE, _LETTER, _OTHER, _DIGIT, _CARE = range(5)
_CLASS = np.full(256, _CARE, np.uint8)
_CLASS[:128] = _OTHER
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[39] = _CARE
_MARK = "\x01"


class Encoder:
    """Tokenizer with a store of known runs, emptied when it holds ``most`` of them."""

    def __init__(self, path: str, most: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.most = most
        self._empty()

    def _empty(self) -> None:
        self.known, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _tokens(self, runs: list[str]) -> list[list[int]]:
        out: list[list[int] | None] = [None] * len(runs)
        plain = [i for i, r in enumerate(runs) if _MARK not in r]
        for k in range(0, len(plain), 1000):
            some = plain[k:k + 1000]
            text = "".join(f"{runs[i]} {_MARK} " for i in some)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.flatnonzero(ids == self.mark[0]) if len(self.mark) == 1 else np.zeros(0, int)
            if len(cut) == len(some):
                for i, part in zip(some, np.split(ids, cut)):
                    out[i] = (part[1:] if len(part) and part[0] == self.mark[0] else part).tolist()
        for i, r in enumerate(runs):
            if out[i] is None:
                out[i] = self.tokenizer.encode(r, add_special_tokens=False).ids
        return out

    def _learn(self, h: np.ndarray, runs: list[str]) -> None:
        if len(self.known) + len(h) > self.most and len(self.known):
            raise MemoryError
        found = self._tokens(runs)
        size = np.array([len(f) for f in found], np.int64)
        at = len(self.ids) + np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
        self.ids = np.concatenate([self.ids, np.array([x for f in found for x in f], np.uint32)])
        known, at = np.concatenate([self.known, h]), np.concatenate([self.at, at])
        size = np.concatenate([self.size, size])
        order = np.argsort(known, kind="stable")
        self.known, self.at, self.size = known[order], at[order], size[order]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and each text's first place in it."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        data, starts, ends, at = _runs(data, offsets)
        h = B.hashes(data, starts, ends)
        new, one, which = np.unique(h, return_index=True, return_inverse=True)
        for _ in range(2):
            spot = np.searchsorted(self.known, new)
            seen = spot < len(self.known)
            seen[seen] = self.known[spot[seen]] == new[seen]
            if seen.all():
                break
            todo = one[~seen]
            try:
                self._learn(new[~seen], [data[starts[i]:ends[i]].tobytes().decode("utf-8", "replace") for i in todo])
            except MemoryError:
                self._empty()
                self._learn(new, [data[starts[i]:ends[i]].tobytes().decode("utf-8", "replace") for i in one])
        spot = np.searchsorted(self.known, new)
        first, size = self.at[spot][which], self.size[spot][which]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(first - total[:-1], size) + np.arange(total[-1])]
        return ids, total[at]


def _runs(data: np.ndarray, offsets: np.ndarray):
    """Text bytes with plain capitals folded, and the runs to tokenize."""
    starts, ends, _ = B.spans(data, offsets, B.WORD)
    kind = _CLASS[data]
    latin = np.flatnonzero(data[:-1] == 0xC3)
    latin = latin[(data[latin + 1] != 0x97) & (data[latin + 1] != 0xB7)]
    kind[latin] = kind[latin + 1] = _LETTER
    odd = np.flatnonzero(kind == _CARE)
    less = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
    careful = np.zeros(len(data) + 1, np.int8)
    if len(odd) or len(less):
        held = np.unique(np.searchsorted(starts, np.concatenate([odd, less]), "right") - 1)
        careful[starts[held]] += 1
        np.add.at(careful, ends[held], -1)
        careful = np.cumsum(careful, dtype=np.int8)
    plain = careful[:-1] == 0
    edge = kind == _DIGIT
    edge[1:] |= kind[1:] != kind[:-1]
    edge &= plain & (kind != _SPACE)
    edge[starts] = True
    first = np.flatnonzero(edge)
    last = np.minimum(np.append(first[1:], len(data)), ends[np.searchsorted(starts, first, "right") - 1])
    return np.where(plain, B.LOWER[data], data), first, last, np.searchsorted(first, offsets)


_HELD: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _HELD:
        _HELD[path] = Encoder(path)
    return _HELD[path]
