"""Words and hashes of whole batches of texts as numpy arrays, for use inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Texts are handled in chunks of about this many bytes, so that a task's memory doesn't grow with a batch. A longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POWERS = np.ones(1, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def _table(seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(np.arange(1, 257, dtype=np.uint64) * _ODD + np.uint64(seed))


_BYTE_VALUES = _table(7)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that separate words: ASCII white space, or everything in ASCII but letters and digits.
IN_SPACED_WORD = np.ones(256, bool)
IN_SPACED_WORD[[9, 10, 11, 12, 13, 32]] = False
IN_LETTER_WORD = np.zeros(256, bool)
IN_LETTER_WORD[48:58] = IN_LETTER_WORD[65:91] = IN_LETTER_WORD[97:123] = IN_LETTER_WORD[128:] = True


def _powers(n: int) -> np.ndarray:
    """Powers of an odd number modulo 2^64, as many as the longest word needs."""
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 64), _ODD | np.uint64(1), np.uint64)]))
    return _POWERS


@dataclass
class Words:
    """Words of some texts: byte places in ``data``, the text they belong to and a 64-bit hash of each."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    hashes: np.ndarray
    n_texts: int


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of a string column; null counts as empty.

    Every text is followed by one line feed, so that no word crosses from one text into the next.
    """
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        own = offsets[at : upto + 1] - offsets[at]
        data = np.full(int(own[-1]) + upto - at, 10, np.uint8)
        keep = np.ones(len(data), bool)
        keep[own[1:] + np.arange(upto - at)] = False
        data[keep] = raw[offsets[at] : offsets[upto]]
        yield at, data, own + np.arange(upto - at + 1)
        at = upto


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool = True) -> Words:
    """Maximal runs of ``inside`` bytes; the hash covers the bytes with A-Z lower-cased if asked for."""
    mask = inside[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    n = len(offsets) - 1
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, none, np.zeros(0, np.uint64), n)
    text = np.searchsorted(offsets, starts, "right") - 1
    at = np.flatnonzero(mask)
    lengths = ends - starts
    within = np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    values = _BYTE_VALUES[LOWER[data[at]] if lower else data[at]]
    with np.errstate(over="ignore"):
        values = values * _powers(int(lengths.max()) + 1)[within]
        sums = np.add.reduceat(values, np.cumsum(lengths) - lengths)
        return Words(data, starts, ends, text, mixed(sums + lengths.astype(np.uint64) * _M2), n)


def prefix_hashes(w: Words, n_bytes: int) -> np.ndarray:
    """Hash of the first bytes of every word (the whole word if it is shorter)."""
    if not len(w.starts):
        return w.hashes
    out = np.zeros(len(w.starts), np.uint64)
    power = _powers(n_bytes + 1)
    with np.errstate(over="ignore"):
        for k in range(n_bytes):
            at = np.minimum(w.starts + k, len(w.data) - 1)
            out += np.where(w.starts + k < w.ends, _BYTE_VALUES[LOWER[w.data[at]]] * power[k], np.uint64(0))
        return mixed(out + np.minimum(w.ends - w.starts, n_bytes).astype(np.uint64) * _M1)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of every text, sorted by both.

    A text with fewer words than ``size``, but not none, has its whole sequence as the one shingle.
    """
    counts = np.bincount(w.text, minlength=w.n_texts) if len(w.text) else np.zeros(w.n_texts, np.int64)
    first = np.cumsum(counts) - counts
    n = len(w.hashes)
    with np.errstate(over="ignore"):
        total = np.zeros(max(n - size + 1, 0), np.uint64)
        for k in range(size):
            total = mixed(total * _ODD + w.hashes[k : k + len(total)] + np.uint64(k + 1))
        full = w.text[: len(total)] == w.text[size - 1 : size - 1 + len(total)] if len(total) else np.zeros(0, bool)
        texts, hashes = [w.text[: len(total)][full]], [total[full]]
        for length in range(1, size):  # short texts
            short = np.flatnonzero(counts == length)
            if len(short):
                h = np.zeros(len(short), np.uint64)
                for k in range(length):
                    h = mixed(h * _ODD + w.hashes[first[short] + k] + np.uint64(k + 1))
                texts.append(short)
                hashes.append(mixed(h + np.uint64(length) * _M1))
    text, value = np.concatenate(texts), np.concatenate(hashes)
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    if len(text):
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
        text, value = text[new], value[new]
    return text, value


def code_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For every byte place of a chunk (and its end): the number of code points before it, counted from its text's start."""
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    base = np.repeat(before[offsets[:-1]], np.diff(offsets))
    return np.concatenate([before[:-1] - base, [0]])
