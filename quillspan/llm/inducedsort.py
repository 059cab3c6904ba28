"""External induced suffix sorting with common-prefix values, over shards on disk.

The text of a shard lies in a file. Suffixes wait in bucket queues, one bucket for each
first symbol, which spill to disk: since suffixes are induced in the order in which the
scan meets their successors, a bucket taken first in, first out, is a priority queue by
(symbol, rank of the successor). With each suffix goes its common prefix with the one
before it, so that the queues yield the order and the common prefixes together.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterator

import numpy as np

#: Entries that the queues of one scan hold in memory; the rest is on disk.
MEMORY = 200_000
#: Symbols of a reduced text that is sorted in memory; a longer one is induced like the text it stands for.
REDUCED = 1 << 20
#: Entries that a scan takes at once.
BATCH = 1 << 17
FAR = np.int32(1 << 30)


class BucketQueues:
    """First-in, first-out queues of (position, common prefix) by symbol; spilled when large."""

    def __init__(self, folder: str, memory: int):
        self.folder = tempfile.mkdtemp(dir=folder)
        self.memory, self.held = memory, 0
        self.chunks: dict[int, list[np.ndarray]] = {}
        self.on_disk: set[int] = set()

    def push(self, symbol: int, entries: np.ndarray) -> None:
        self.chunks.setdefault(symbol, []).append(entries.astype(np.int32))
        self.held += len(entries)
        if self.held > self.memory:
            for s, parts in self.chunks.items():
                with open(f"{self.folder}/{s}", "ab") as f:
                    for part in parts:
                        f.write(part.tobytes())
                self.on_disk.add(s)
            self.chunks, self.held = {}, 0

    def pop(self, symbol: int, backwards: bool = False) -> Iterator[np.ndarray]:
        """What is queued now, in batches; what is pushed meanwhile waits for the next call."""
        parts = self.chunks.pop(symbol, [])
        self.held -= sum(map(len, parts))
        path = f"{self.folder}/{symbol}"
        if symbol in self.on_disk:
            self.on_disk.discard(symbol)
            os.rename(path, path + ".taken")
            parts = [np.memmap(path + ".taken", dtype=np.int32, mode="r").reshape(-1, 2), *parts]
        waiting: list[np.ndarray] = []
        size = 0
        for part in reversed(parts) if backwards else parts:
            for i in range(0, len(part), BATCH):
                waiting.append(part[::-1][i : i + BATCH] if backwards else part[i : i + BATCH])
                size += len(waiting[-1])
                if size >= BATCH:
                    yield np.concatenate(waiting)
                    waiting, size = [], 0
        if waiting:
            yield np.concatenate(waiting)
        if os.path.exists(path + ".taken"):
            os.unlink(path + ".taken")

    def close(self) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


def types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next (S-type); the last one isn't."""
    n = len(text)
    out = np.zeros(n, dtype=bool)
    step = BATCH * 4
    after = False
    for end in range(n, 0, -step):
        begin = max(0, end - step)
        part = text[begin : min(end + 1, n)].astype(np.int64)
        rise = np.sign(np.diff(part)).astype(np.int8)
        if end == n:
            rise = np.r_[rise, np.int8(-1)]
        # An equal neighbour has the type of the first place behind it that differs.
        at = np.where(rise != 0, np.arange(len(rise)), len(rise))
        at = np.minimum.accumulate(at[::-1])[::-1]
        out[begin:end] = np.where(at < len(rise), rise[np.minimum(at, len(rise) - 1)] > 0, after)
        after = out[begin]
    return out


def starts_of_rises(small: np.ndarray) -> np.ndarray:
    """Leftmost S-type places: S-type with an L-type place before."""
    return np.flatnonzero(small[1:] & ~small[:-1]) + 1


class Carrier:
    """For each symbol, the least common prefix met since the last suffix pushed to it."""

    def __init__(self, symbols: int):
        self.least = np.full(symbols, FAR, dtype=np.int32)

    def take(self, prefixes: np.ndarray, groups: list[tuple[int, np.ndarray]]) -> list[np.ndarray]:
        """Common prefixes of the pushed suffixes; ``groups`` has the places of each symbol in the batch."""
        out, tails = [], []
        for symbol, places in groups:
            begins = np.concatenate([[0], places[:-1] + 1])
            last = places[-1] + 1
            found = np.minimum.reduceat(prefixes[:last], begins)
            found[0] = min(found[0], self.least[symbol])
            out.append(found.astype(np.int64) + 1)
            tails.append(prefixes[last:].min() if last < len(prefixes) else FAR)
        np.minimum(self.least, prefixes.min(), out=self.least)
        for (symbol, _), tail in zip(groups, tails):
            self.least[symbol] = tail
        return out


def run_length(text: np.ndarray, place: int, most: int) -> int:
    part = np.asarray(text[place : place + most])
    other = np.flatnonzero(part != part[0])
    return int(other[0]) if len(other) else len(part)


def induce(
    text: np.ndarray, small: np.ndarray, seeds: np.ndarray, symbols: np.ndarray, emit: Callable[[np.ndarray, np.ndarray], None],
    folder: str, *, prefixes: np.ndarray | None = None, cap: int = 400, memory: int = MEMORY,
) -> None:
    """Induce all suffixes from sorted leftmost S-type ones; ``emit`` gets them from the largest down.

    ``seeds`` are in order; ``prefixes`` has the common prefix of each with the one before.
    ``emit`` gets positions, and the common prefix of each with the one emitted before it.
    """
    carried = prefixes is not None
    alphabet = int(symbols[-1]) + 1 if carried else 1
    first = np.asarray(text[seeds]) if len(seeds) else np.empty(0, text.dtype)
    cuts = np.searchsorted(first, symbols), np.searchsorted(first, symbols, side="right")
    queues, larger = BucketQueues(folder, memory), BucketQueues(folder, memory)

    def push(queue: BucketQueues, carrier: Carrier, batch: np.ndarray, lower: bool) -> None:
        """Queue the predecessors of a batch: L-type ones if not ``lower``, else S-type ones."""
        has = batch[:, 0] > 0
        before = np.maximum(batch[:, 0] - 1, 0)
        wanted = np.flatnonzero(has & (small[before] == lower))
        chars = text[before[wanted]]
        order = np.argsort(chars, kind="stable")
        kinds, begins = np.unique(chars[order], return_index=True)
        groups = [(int(s), wanted[places]) for s, places in zip(kinds, np.split(order, begins[1:]))] if len(wanted) else []
        shared = carrier.take(batch[:, 1].astype(np.int32), groups) if carried and len(batch) else [np.zeros(len(p), np.int64) for _, p in groups]
        for (symbol, places), common in zip(groups, shared):
            queue.push(symbol, np.column_stack([before[places], np.minimum(common, cap)]))

    try:
        carrier = Carrier(alphabet) if carried else None
        # The empty suffix comes first; the last place is L-type and its predecessor.
        push(queues, carrier, np.array([[len(text), 0]]), False)
        for symbol, a, b in zip(symbols.tolist(), *(c.tolist() for c in cuts)):
            last, fresh = -1, True
            while True:
                more = False
                for batch in queues.pop(symbol):
                    batch = np.array(batch)
                    if fresh:
                        batch[0, 1] = 0
                        fresh = False
                    more, last = True, int(batch[-1, 0])
                    larger.push(symbol, batch)
                    push(queues, carrier, batch, False)
                if not more:
                    break
            for i in range(a, b, BATCH):
                own = seeds[i : min(b, i + BATCH)]
                batch = np.column_stack([own, prefixes[i : i + len(own)] if carried else np.zeros(len(own), np.int64)])
                if i == a and carried:
                    batch[0, 1] = 0 if last < 0 else min(cap, run_length(text, last, cap), run_length(text, int(own[0]), cap))
                push(queues, carrier, batch, False)
        queues.close()
        queues = BucketQueues(folder, memory)
        carrier = Carrier(alphabet) if carried else None
        for symbol in symbols[::-1].tolist():
            last, fresh = -1, True
            while True:
                more = False
                for batch in queues.pop(symbol):
                    batch = np.array(batch)
                    if fresh:
                        batch[0, 1] = 0
                        fresh = False
                    more, last = True, int(batch[-1, 0])
                    emit(batch[:, 0], batch[:, 1])
                    push(queues, carrier, batch, True)
                if not more:
                    break
            # Backwards, a suffix's common prefix with the one met before it is stored with that one.
            with_next = None
            for batch in larger.pop(symbol, backwards=True):
                batch = np.array(batch)
                own = batch[:, 1].copy()
                batch[1:, 1] = own[:-1]
                if with_next is None:
                    batch[0, 1] = 0 if last < 0 or not carried else min(cap, run_length(text, last, cap), run_length(text, int(batch[0, 0]), cap))
                else:
                    batch[0, 1] = with_next
                with_next = own[-1]
                emit(batch[:, 0], batch[:, 1])
                push(queues, carrier, batch, True)
    finally:
        queues.close()
        larger.close()


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int, ends: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Common prefix of the suffixes at each pair of places, up to ``cap`` symbols (or up to given ends)."""
    n, out = len(text), np.zeros(len(a), dtype=np.int64)
    live, done, step = np.arange(len(a)), 0, 8
    while len(live) and done < cap:
        step = min(step * 2, 32, cap - done)
        still = []
        for i in range(0, len(live), BATCH // 8):
            part = live[i : i + BATCH // 8]
            x, y = a[part, None] + done + np.arange(step), b[part, None] + done + np.arange(step)
            same = (text[np.minimum(x, n - 1)] == text[np.minimum(y, n - 1)]) & (x < n) & (y < n)
            met = np.where(same.all(axis=1), step, (~same).argmax(axis=1))
            out[part] += met
            still.append(part[met == step])
        live, done = np.concatenate(still), done + step
    return out


def sort_in_memory(text: np.ndarray, longest: int) -> np.ndarray:
    """Order of all suffixes by their first ``longest`` symbols at least, by doubling."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, width = len(text), 1
    order = np.argsort(rank, kind="stable")
    while width < longest and n > 1 and int(rank.max()) < n - 1:
        behind = np.zeros(n, dtype=np.int64)
        behind[: max(0, n - width)] = rank[width:] + 1
        key = rank * (n + 1) + behind
        order = np.argsort(key, kind="stable")
        rank[order] = np.cumsum(np.r_[0, np.diff(key[order]) != 0])
        width *= 2
    return order


def sorted_seeds(text: np.ndarray, small: np.ndarray, symbols: np.ndarray, folder: str, cap: int, memory: int, reduced: int) -> np.ndarray:
    """Leftmost S-type places in the order of their suffixes, by naming and, if names repeat, recursion."""
    seeds = starts_of_rises(small)
    if len(seeds) < 2:
        return seeds
    is_seed = np.zeros(len(text), dtype=bool)
    is_seed[seeds] = True
    found: list[np.ndarray] = []
    by_symbol = seeds[np.argsort(text[seeds], kind="stable")]
    induce(text, small, by_symbol, symbols, lambda p, _: found.append(p[is_seed[p]]), folder, memory=memory)
    order = np.concatenate(found)[::-1]  # by the substrings that reach to the next seed
    number = np.empty(len(text), dtype=np.int64)
    number[seeds] = np.arange(len(seeds))
    ends = np.r_[seeds[1:], len(text) - 1]
    sizes = ends[number[order]] - order + 1
    new = np.r_[True, sizes[1:] != sizes[:-1]]
    same_size = np.flatnonzero(~new)
    if len(same_size):
        longest = int(sizes[same_size].max())
        common = common_prefixes(text, order[same_size - 1], order[same_size], longest)
        new[same_size] = common < sizes[same_size]
    names = np.empty(len(seeds), dtype=np.int64)
    names[number[order]] = np.cumsum(new) - 1
    del number, is_seed
    if new.all():
        return order
    if len(names) <= reduced:
        return seeds[sort_in_memory(names, cap)]
    inner = types(names)
    kinds = np.unique(names)
    upper = sorted_seeds(names, inner, kinds, folder, cap, memory, reduced)
    parts: list[np.ndarray] = []
    induce(names, inner, upper, kinds, lambda p, _: parts.append(p), folder, memory=memory)
    return seeds[np.concatenate(parts)[::-1]]


def repeats(text: np.ndarray, length: int, folder: str, *, memory: int = MEMORY, reduced: int = REDUCED) -> np.ndarray:
    """For each place of ``text``, whether its ``length`` symbols also start at another place."""
    out = np.zeros(len(text), dtype=bool)
    if len(text) <= length:
        return out
    small, symbols = types(text), np.unique(text).astype(np.int64)
    seeds = sorted_seeds(text, small, symbols, folder, length, memory, reduced)
    prefixes = np.zeros(len(seeds), dtype=np.int64)
    if len(seeds) > 1:
        prefixes[1:] = common_prefixes(text, seeds[:-1], seeds[1:], length)
    above = -1

    def mark(places: np.ndarray, common: np.ndarray) -> None:
        nonlocal above
        hit = np.flatnonzero(common >= length)
        out[places[hit]] = True
        out[np.where(hit > 0, places[np.maximum(hit - 1, 0)], above)] = True
        above = int(places[-1])

    induce(text, small, seeds, symbols, mark, folder, prefixes=prefixes, cap=length, memory=memory)
    return out
