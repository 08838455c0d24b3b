"""Token ids of whole batches of texts from the ids of their parts, without a step in Python for each part.

The bytes of a batch are cut before spaces and line ends. A part of at most 15 bytes is its own key in a hash table of
numpy arrays, which finds the entries of all parts at once; only parts that it lacks are encoded one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Parts whose ids a table keeps before it starts anew; bounds memory (about 60 bytes a part), not results.
MEMO_ENTRIES = 600_000
#: Parts that are looked up at once, and bytes of text that a batch is cut to.
CHUNK, SLICE_BYTES = 100_000, 1_000_000


def _grown(array_: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array_):
        return array_
    out = np.zeros((max(size, 2 * len(array_)), *array_.shape[1:]), array_.dtype)
    out[: len(array_)] = array_
    return out


def gathered(arena: np.ndarray, bounds: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the arena's stretches of some entries one after the other, where each one ends); entry i lies between its bounds."""
    begins = bounds[entries]
    sizes = bounds[entries + 1] - begins
    ends = np.cumsum(sizes)
    out = np.empty(ends[-1] if len(ends) else 0, arena.dtype)
    for i in range(0, len(entries), CHUNK):
        own = sizes[i : i + CHUNK]
        first = ends[i] - own[0]
        steps = np.repeat(begins[i : i + CHUNK] - ends[i : i + CHUNK] + own, own)
        out[first : first + len(steps)] = arena[steps + np.arange(first, first + len(steps))]
    return out, ends


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose texts have about ``SLICE_BYTES`` together, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy())
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right")))
        yield batch.slice(at, to - at)
        at = to


class PartTable:
    """Ids of parts of text in one arena, found by open addressing. A key is two 64-bit numbers of a part's bytes, zeros
    and its length. ``encode`` gives the packed ids of each of some parts; ``end`` those at the end of every text."""

    def __init__(self, dtype: str, end: bytes, encode: Callable[[list[bytes]], list[bytes]], entries: int | None = None):
        self.dtype, self.end, self.encode, self.most = np.dtype(dtype), end, encode, entries or MEMO_ENTRIES
        self.clear()

    def clear(self) -> None:
        self.slots = np.full(1 << 16, -1, np.int32)
        self.keys = np.zeros((1 << 15, 2), np.uint64)
        self.bounds = np.zeros((1 << 15) + 1, np.int64)
        self.arena = np.zeros(1 << 17, self.dtype)
        self.size = 0
        self.long: dict[bytes, int] = {}
        self.add(np.zeros((1, 2), np.uint64), [self.end])  # entry 0 ends a text

    def _spots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ (keys[:, 1] ^ keys[:, 1] >> np.uint64(32)) * np.uint64(0xC2B2AE3D27D4EB4F)
        for shift in (32, 29):
            mixed ^= mixed >> np.uint64(shift)
            mixed *= np.uint64(0xD6E8FEB86659FD93)
        return (mixed >> np.uint64(32)).astype(np.int64) & len(self.slots) - 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 for unknown ones."""
        out, spots, left = np.full(len(keys), -1, np.int64), self._spots(keys), None
        while True:
            entry = self.slots[spots]
            own = keys if left is None else keys[left]
            hit = (entry >= 0) & (self.keys[entry, 0] == own[:, 0]) & (self.keys[entry, 1] == own[:, 1])
            out[hit if left is None else left[hit]] = entry[hit]
            go = np.flatnonzero((entry >= 0) & ~hit)
            if not len(go):
                return out
            left = go if left is None else left[go]
            spots = spots[go] + 1 & len(self.slots) - 1

    def add(self, keys: np.ndarray, ids: list[bytes], findable: bool = True) -> np.ndarray:
        """New entries, of distinct keys that aren't known."""
        first, self.size = self.size, self.size + len(ids)
        packed = np.frombuffer(b"".join(ids), self.dtype)
        ends = self.bounds[first] + np.cumsum([len(x) // self.dtype.itemsize for x in ids])
        self.keys, self.bounds, self.arena = _grown(self.keys, self.size), _grown(self.bounds, self.size + 1), _grown(self.arena, int(ends[-1]) if len(ends) else 0)
        self.bounds[first + 1 : self.size + 1] = ends
        self.arena[self.bounds[first] : self.bounds[self.size]] = packed
        entries = np.arange(first, self.size)
        self.keys[entries] = keys if findable else 0
        if findable:
            if 2 * self.size > len(self.slots):
                self.slots = np.full(4 * len(self.slots), -1, np.int32)
                entries = np.flatnonzero(self.keys[: self.size].any(axis=1))
            self._place(entries)
        return np.arange(first, self.size)

    def _place(self, entries: np.ndarray) -> None:
        spots = self._spots(self.keys[entries])
        while len(entries):
            free = np.flatnonzero(self.slots[spots] < 0)
            self.slots[spots[free]] = entries[free]
            go = np.flatnonzero(self.slots[spots] != entries)
            entries, spots = entries[go], spots[go] + 1 & len(self.slots) - 1

    def texts(self, column: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts and their ends one after the other, borders of the texts among them: one more than texts).

        Nulls are empty. The encoder must give a part the same ids alone as in its text.
        """
        column = pa.concat_arrays([column.fill_null("")])
        offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
        source = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        cuts = (source == 32) | (source == 10)
        cuts[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(cuts)
        if self.size > self.most:
            self.clear()
        stops = np.append(starts[1:], len(source))
        entries = np.concatenate([self._entries(source, starts[i : i + CHUNK], stops[i : i + CHUNK]) for i in range(0, max(1, len(starts)), CHUNK)])
        ends = np.searchsorted(starts, offsets[1:])
        data, made = gathered(self.arena, self.bounds, np.insert(entries, ends, 0))
        return data, np.append(0, made[ends + np.arange(len(ends))])

    def _entries(self, source: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The entries of the parts between ``starts`` and ``ends``; what is lacking is encoded and added."""
        if not len(starts):
            return starts
        sizes = ends - starts
        letters = np.lib.stride_tricks.sliding_window_view(np.append(source, np.zeros(16, np.uint8)), 16)[starts]
        letters[np.arange(16) >= sizes[:, None]] = 0
        letters[:, 15] = np.minimum(sizes, 16)
        keys = letters.view("<u8")
        entries = self.find(keys)
        entries[sizes > 15] = -1
        self._long(source, starts, ends, np.flatnonzero(sizes > 15).tolist(), entries)
        lacking = np.flatnonzero(entries < 0)
        if len(lacking):
            order = np.lexsort((keys[lacking, 0], keys[lacking, 1]))
            own = keys[lacking[order]]
            new = np.append(True, (own[1:] != own[:-1]).any(axis=1))
            picked = lacking[order[new]]
            added = self.add(keys[picked], self.encode([source[s:e].tobytes() for s, e in zip(starts[picked].tolist(), ends[picked].tolist(), strict=True)]))
            entries[lacking[order]] = added[np.cumsum(new) - 1]
        return entries

    def _long(self, source: np.ndarray, starts: np.ndarray, ends: np.ndarray, places: list[int], entries: np.ndarray) -> None:
        parts = [source[starts[i] : ends[i]].tobytes() for i in places]
        new = list(dict.fromkeys(x for x in parts if x not in self.long))
        if new:
            self.long.update(zip(new, self.add(np.zeros((len(new), 2), np.uint64), self.encode(new), findable=False).tolist(), strict=True))
        entries[places] = [self.long[x] for x in parts]
