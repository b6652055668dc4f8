"""Words of Arrow text columns as byte spans and ids, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WORD, GAP, BREAK = 0, 1, 2  # kinds of bytes: of words, between words, between pieces


def kinds(gaps: bytes, breaks: bytes = b"") -> np.ndarray:
    """The kind of each byte value; bytes of neither set belong to words."""
    table = np.zeros(256, np.uint8)
    table[list(gaps)] = GAP
    table[list(breaks)] = BREAK
    return table


def content(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and where each text starts; one end more than texts.  Nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], wide)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and which bytes are theirs; no word reaches from one text into the next."""
    own = table[data] == WORD
    first, last = own.copy(), own.copy()
    first[1:] &= ~own[:-1]
    last[:-1] &= ~own[1:]
    full = offsets[:-1] < offsets[1:]
    at, end = offsets[:-1][full], offsets[1:][full] - 1
    first[at], last[end] = own[at], own[end]
    return np.flatnonzero(first), np.flatnonzero(last) + 1, own


def encode(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The id of each word and the distinct words, ids being their places."""
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[own])])
    coded = array.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary
