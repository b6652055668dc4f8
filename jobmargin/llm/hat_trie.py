"""Counts of word sequences in burstable hash containers under a shallow trie of word ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ID = np.dtype("<i4")


class _Node(dict):
    """A burst container: one container for each next id."""


class HatTrie:
    """Counts of sequences of ids.

    The first id leads to a hash container of what follows it, as bytes; a container that reaches
    `burst` entries bursts into containers by the second id, if more ids follow.  Beyond `held`
    entries `add` gives back the largest subtrees, whole, until half of them are left.
    """

    def __init__(self, burst: int, held: int):
        self.burst, self.held = burst, held
        self.root: dict[int, dict] = {}
        self.sizes: dict[int, int] = {}
        self.entries = 0

    def add(self, rows: np.ndarray, counts: np.ndarray) -> list[tuple[int, dict]]:
        """Add distinct sequences in order, one a row; returns the (first id, container) of spilled subtrees."""
        if not len(rows):
            return []
        rest = np.ascontiguousarray(rows[:, 1:], ID)
        keys = rest.view(f"V{rest.shape[1] * ID.itemsize}").ravel().tolist() if rest.shape[1] else [b""] * len(rows)
        numbers = counts.tolist()
        edges = np.flatnonzero(np.diff(rows[:, 0], prepend=-1)).tolist() + [len(rows)]
        for first, a, b in zip(rows[edges[:-1], 0].tolist(), edges[:-1], edges[1:]):
            held = self.root.setdefault(first, {})
            before = self.sizes.get(first, 0)
            if isinstance(held, _Node):
                grown = 0
                for key, count in zip(keys[a:b], numbers[a:b]):
                    below = held.setdefault(key[:4], {})   # under b"" for the first word alone
                    size = len(below)
                    below[key[4:]] = below.get(key[4:], 0) + count
                    grown += len(below) - size
            else:
                for key, count in zip(keys[a:b], numbers[a:b]):
                    held[key] = held.get(key, 0) + count
                grown = len(held) - before
                if len(held) >= self.burst and rest.shape[1] > 1:
                    node = self.root[first] = _Node()
                    for key, count in held.items():
                        node.setdefault(key[:4], {})[key[4:]] = count
            self.sizes[first] = before + grown
            self.entries += grown
        return self.spill(self.held // 2) if self.entries > self.held else []

    def spill(self, keep: int = 0) -> list[tuple[int, dict]]:
        """Take out whole subtrees, the largest first, until at most `keep` entries are left."""
        out = []
        for first in sorted(self.sizes, key=self.sizes.get, reverse=True):
            if self.entries <= keep:
                break
            self.entries -= self.sizes.pop(first)
            out.append((first, self.root.pop(first)))
        return out


def sequences(subtrees: list[tuple[int, dict]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of ids, counts) of subtrees, sequences of one length together."""
    by_length: dict[int, tuple[list, list, list]] = {}
    for first, container in subtrees:
        below = container.items() if isinstance(container, _Node) else [(b"", container)]
        for lead, own in below:
            for key, count in own.items():
                firsts, keys, counts = by_length.setdefault(len(lead) + len(key), ([], [], []))
                firsts.append(first)
                keys.append(lead + key)
                counts.append(count)
    for length, (firsts, keys, counts) in by_length.items():
        rest = np.frombuffer(b"".join(keys), ID).reshape(len(keys), length // ID.itemsize)
        yield np.column_stack([np.array(firsts, ID), rest]), np.array(counts, np.int64)


def sorted_run(subtrees: list[tuple[int, dict]], words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Phrases (words joined by a space) and counts of subtrees, in the order of the phrases."""
    texts, counts = [pa.array([], words.type)], [np.zeros(0, np.int64)]
    for rows, own in sequences(subtrees):
        texts.append(pc.binary_join_element_wise(*[words.take(pa.array(rows[:, c])) for c in range(rows.shape[1])], pa.scalar(" ", words.type)))
        counts.append(own)
    phrases, numbers = pa.concat_arrays(texts), pa.array(np.concatenate(counts))
    order = pc.sort_indices(phrases)
    return phrases.take(order), numbers.take(order)
