"""A minimal acyclic automaton over words, numbered by perfect hashing, in a mappable file."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Sequence

import numpy as np

MAGIC = b"QSLEX001"


def compile_lexicon(words: Sequence[bytes], outputs: Sequence[Sequence[int]]) -> bytes:
    """The file of an automaton that accepts the words, in ascending order without repeats.

    States with equal futures are one state, so that suffixes are shared. An arc holds how
    many accepted words come before those behind it; these numbers add up to the word's
    place in the order, under which its output ids are stored.
    """
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []
    # The path of the last word: for each state whether it is final, and its arcs so far.
    path: list[list] = [[False, []]]

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    def fold(depth: int) -> None:
        while len(path) - 1 > depth:
            done = path.pop()
            label, _ = path[-1][1][-1]
            path[-1][1][-1] = (label, freeze(done))

    last = b""
    for word in words:
        same = len(os.path.commonprefix([last, word]))
        fold(same)
        for label in word[same:]:
            path[-1][1].append((label, -1))
            path.append([False, []])
        path[-1][0] = True
        last = word
    fold(0)
    start = freeze(path[0])

    accepted = np.zeros(len(states), dtype=np.int64)  # children are numbered before their parents
    keys, targets, skips = [], [], []
    for i, (final, arcs) in enumerate(states):
        before = int(final)
        for label, target in arcs:
            keys.append(i * 256 + label)
            targets.append(target)
            skips.append(before)
            before += int(accepted[target])
        accepted[i] = before
    order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
    ends = np.cumsum([0, *map(len, outputs)], dtype=np.int64)
    flat = np.array([x for ids in outputs for x in ids], dtype=np.int32)
    arrays = [
        np.array(keys, dtype=np.int64)[order],
        np.array(targets, dtype=np.int32)[order],
        np.array(skips, dtype=np.int32)[order],
        np.array([final for final, _ in states], dtype=np.uint8),
        ends,
        flat,
    ]
    head = np.array([start, *map(len, arrays)], dtype=np.int64).tobytes()
    return MAGIC + head + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)


class Lexicon:
    """Looks words up in a compiled automaton that is mapped from a file."""

    KINDS = (np.int64, np.int32, np.int32, np.uint8, np.int64, np.int32)

    def __init__(self, path: str):
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        if raw[:8].tobytes() != MAGIC:
            raise ValueError("not a lexicon file")
        head = raw[8 : 8 + 56].view(np.int64)
        at, arrays = 64, []
        for kind, n in zip(self.KINDS, head[1:].tolist()):
            size = n * np.dtype(kind).itemsize
            arrays.append(raw[at : at + size].view(kind))
            at += size + -size % 8
        self.start = int(head[0])
        self.keys, self.targets, self.skips, self.finals, self.ends, self.flat = arrays

    @classmethod
    def of_bytes(cls, data: bytes) -> Lexicon:
        """Maps a file that has no name any more, so that nothing is left behind."""
        handle, path = tempfile.mkstemp(suffix=".lex")
        try:
            with os.fdopen(handle, "wb") as f:
                f.write(data)
            return cls(path)
        finally:
            os.unlink(path)

    def places(self, words: Sequence[bytes]) -> np.ndarray:
        """The number of each word, or -1; all words take their next arc together."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        begins = np.cumsum(sizes) - sizes
        state = np.full(len(words), self.start, dtype=np.int64)
        place = np.zeros(len(words), dtype=np.int64)
        live = np.flatnonzero(sizes > 0)
        step = 0
        while len(live) and len(self.keys):
            wanted = state[live] * 256 + data[begins[live] + step]
            arc = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            met = self.keys[arc] == wanted
            place[live[~met]] = -1
            state[live[~met]] = -1
            live, arc = live[met], arc[met]
            place[live] += self.skips[arc]
            state[live] = self.targets[arc]
            step += 1
            live = live[sizes[live] > step]
        if not len(self.keys):
            state[:] = -1
        lost = (state < 0) | (self.finals[np.maximum(state, 0)] == 0)
        return np.where(lost, -1, place)

    def outputs(self, place: int) -> list[int]:
        return self.flat[self.ends[place] : self.ends[place + 1]].tolist()
