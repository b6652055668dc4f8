"""Token ids of whole texts by a `tokenizers` file, remembering words that come again."""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa

from jobmargin.llm import spans

MEMO_WORDS = 200_000   # words remembered by each Python worker, some 35 MB; others are encoded in each slice that has them
LONGEST = 48           # longer words are not worth remembering
SLICE = 2 << 20        # bytes of texts encoded at a time
TOGETHER = 1024        # missed words handed to the tokenizer at a time

MARKS = ".,;:!?"

_MARK, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(MARKS.encode())] = True
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
_ASCII_WHITE = np.zeros(256, bool)
_ASCII_WHITE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
#: UTF-8 of white space beyond ASCII, by leading byte.
_WIDE_WHITE = {
    0xC2: (b"\xc2\x85", b"\xc2\xa0"), 0xE1: (b"\xe1\x9a\x80",),
    0xE2: (*(bytes([0xE2, 0x80, k]) for k in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), b"\xe2\x81\x9f"), 0xE3: (b"\xe3\x80\x80",),
}


def _white(data: np.ndarray) -> np.ndarray:
    """Bytes of white space."""
    white = _ASCII_WHITE[data]
    for lead, texts in _WIDE_WHITE.items():
        at = np.flatnonzero(data == lead)
        for text in texts:
            own = at[at + len(text) <= len(data)]
            for k in range(1, len(text)):
                own = own[data[own + k] == text[k]]
            for k in range(len(text)):
                white[own + k] = True
    return white


def pieces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where a text, a single space between two other characters, or a mark behind a letter begins; all bytes lie between two of these places.

    Letters are those up to U+024F.
    """
    white = _white(data)
    cut = data == 0x20
    cut[1:] &= ~white[:-1]
    cut[:-1] &= ~white[1:]
    filled = offsets[:-1] < offsets[1:]
    cut[offsets[1:][filled] - 1] = False
    at = np.flatnonzero(_MARK[data])
    at = at[at > 1]
    last, lead = data[at - 1], data[at - 2]
    wide = (lead == 0xC3) & (last != 0x97) & (last != 0xB7) | (lead >= 0xC4) & (lead <= 0xC8) | (lead == 0xC9) & (last <= 0x8F)
    cut[at[_LETTER[last] | wide]] = True
    cut[offsets[:-1][filled]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Ids of whole texts as unsigned 32-bit numbers of the machine (little-endian).

    Byte-level pre-tokenisation lets no token reach across a single space between two
    other characters (the space opens the next token), so what lies between such spaces
    may be encoded apart; so may letters and the mark behind them.  Each distinct piece of a slice is
    looked up or encoded once.  Texts are never normalised, truncated or padded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self._tokenizer = tokenizer
        self._place: dict[bytes, int] = {}
        self._known = np.zeros(0, "<u4"), np.zeros(0, np.int64)     # ids of the remembered words in a row, and how many each has

    def encode(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        return self.batch(pa.array([text], pa.string()))[0].tobytes()

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after the other, and how many each has."""
        ids, counts = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        step = max(1, len(texts) * SLICE // max(texts.nbytes, 1))
        for at in range(0, len(texts), step):
            own_ids, own_counts = self._slice(*spans.content(texts.slice(at, step)))
            ids.append(own_ids)
            counts.append(own_counts)
        return np.concatenate(ids), np.concatenate(counts)

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = pieces(data, offsets)
        array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)])
        coded = array.dictionary_encode()
        place, flat, lengths = self._ids(coded.dictionary.to_pylist())
        begins = np.cumsum(lengths) - lengths
        of = place[coded.indices.to_numpy()]
        sizes = lengths[of]
        ends = np.cumsum(sizes)
        ids = flat[np.arange(int(sizes.sum())) + np.repeat(begins[of] - (ends - sizes), sizes)]
        upto = np.append(0, ends)[np.searchsorted(starts, offsets)]
        return ids, np.diff(upto)

    def _ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The place of each of the distinct pieces among words in a row: their ids, and how many each has."""
        flat, lengths = self._known
        place = np.array([self._place.get(w, -1) for w in words], np.int64)
        at = np.flatnonzero(place < 0)
        missing = [words[k] for k in at.tolist()]
        found = []
        for start in range(0, len(missing), TOGETHER):   # an encoding takes much more memory than its ids
            own = [w.decode("utf-8", "replace") for w in missing[start:start + TOGETHER]]
            found += [e.ids for e in self._tokenizer.encode_batch_fast(own, add_special_tokens=False)]
        place[at] = np.arange(len(lengths), len(lengths) + len(missing))
        flat = np.concatenate([flat, np.fromiter(chain.from_iterable(found), "<u4")])
        lengths = np.concatenate([lengths, np.fromiter(map(len, found), np.int64, len(found))])
        if len(self._place) < MEMO_WORDS:
            self._place.update((w, k) for w, k in zip(missing, place[at].tolist()) if len(w) <= LONGEST)
            self._known = flat, lengths
        return place, flat, lengths


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def version(path: str) -> str:
    """Digest of the tokenizer file: counts of one version are never taken for another's."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
