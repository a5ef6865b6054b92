"""Words, hashes and n-gram counts of whole texts, straight from Arrow's UTF-8 buffers."""

import numpy as np

#: Contract word classes, as byte tables. Every byte of a non-ASCII character is at least 0x80.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[97:123] = _ALNUM[65:91] = _ALNUM[128:] = True

ALNUM_WORDS = "alnum"
SPACED_WORDS = "spaced"
IS_WORD = {ALNUM_WORDS: _ALNUM, SPACED_WORDS: ~_SPACE}
#: bytes.translate tables: A-Z lower-cased, everything outside words a space.
TRANSLATE = {k: bytes(int(_LOWER[i]) if v[i] else 32 for i in range(256)) for k, v in IS_WORD.items()}

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE_CODES = np.random.default_rng(20240131).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE_CODES[65:91] = _BYTE_CODES[97:123]


def buffers(array):
    """(bytes, offsets) of a string column; null rows have length 0."""
    n = len(array)
    if array.type == "large_string":
        raw = np.frombuffer(array.buffers()[1], np.int64)
    elif n:
        raw = np.frombuffer(array.buffers()[1], np.int32)
    else:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = raw[array.offset:array.offset + n + 1].astype(np.int64)
    body = array.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data, offsets


def texts(array):
    """UTF-8 bytes of each row; empty for null."""
    data, offsets = buffers(array)
    view = memoryview(data)
    return [bytes(view[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def chunks(array, limit=CHUNK_BYTES):
    """(first row, bytes, offsets from 0) in runs of rows of about `limit` bytes; a longer text is a run of its own."""
    data, offsets = buffers(array)
    row, n = 0, len(offsets) - 1
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, data[offsets[row]:offsets[last]], offsets[row:last + 1] - offsets[row]
        row = last


def word_bounds(data, offsets, kind):
    """Starts and ends of all words, and for each row the number of the first word at or after it."""
    size = len(data)
    inside = IS_WORD[kind][data]
    before, after = np.zeros(size, bool), np.zeros(size, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[(offsets > 0) & (offsets < size)]
    before[edges] = False
    after[edges - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h):
    """Finalise 64-bit hashes so that every bit depends on every other."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Hasher:
    """64-bit hashes of byte ranges by prefix sums of a polynomial; A-Z count as a-z."""

    def __init__(self):
        self.power = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _grow(self, size):
        if len(self.power) <= size:
            n = size + size // 2 + 16
            inv = np.uint64(pow(_BASE, -1, 1 << 64))
            base = np.full(n, _BASE, np.uint64)
            base[0] = 1
            self.power = np.multiply.accumulate(base)
            base[1:] = inv
            self.inverse = np.multiply.accumulate(base)

    def load(self, data):
        self._grow(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_CODES[data] * self.power[:len(data)], out=self.sums[1:])
        return self

    def ranges(self, starts, ends):
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


def ngram_counts(text: np.ndarray, buckets: int, size=3) -> np.ndarray:
    """Counts of hashed byte n-grams of one lower-cased text."""
    if len(text) < size:
        return np.zeros(buckets, np.float32)
    code = np.zeros(len(text) - size + 1, np.uint32)
    for k in range(size):
        code = code * np.uint32(257) + text[k:len(text) - size + 1 + k]
    code = (code * np.uint32(2654435761)) >> np.uint32(32 - int(buckets).bit_length() + 1)
    return np.bincount(code, minlength=buckets).astype(np.float32)


def letters_only(data: np.ndarray, offsets: np.ndarray):
    """Lower-cased letters with one blank for each run of other signs between them, and the new offsets.

    Letters are A-Z and all non-ASCII characters; Latin-1 capitals count as small letters too.
    """
    low = _LOWER[data]
    latin = np.zeros(len(low), bool)
    latin[1:] = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
    low = low + latin.astype(np.uint8) * np.uint8(32)
    letter = ((low >= 97) & (low <= 122)) | (low >= 128)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    low[~letter] = 32
    return low[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]
