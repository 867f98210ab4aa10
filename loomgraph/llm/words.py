"""Hashes of the words of many texts at once, on their UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from loomgraph.llm.shared import process_cache

#: Texts are hashed in pieces of about so many bytes.
PIECE = 1 << 19
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15 | 2), np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * _MIX
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of :func:`mix`."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = x ^ (x >> np.uint64(29)) ^ (x >> np.uint64(58))
    x = x * np.uint64(pow(int(_MIX), -1, 1 << 64))
    return x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))


def _tables():
    """For each byte whether it is white space, and a number (A-Z as a-z, space 0)."""
    codes = np.arange(256)
    space = (codes == 0x20) | ((codes >= 0x09) & (codes <= 0x0D))
    low = np.where((codes >= 65) & (codes <= 90), codes + 32, codes).astype(np.uint64)
    value = mix((low + np.uint64(1)) * _STEP)
    value[space] = 0
    return space, value


def _powers(n: int):
    """Powers of the hash base and of its inverse, at least ``n``."""
    kept = process_cache("powers")
    if kept.get("n", 0) < n:
        n = max(n, PIECE + (PIECE >> 1))
        base = np.full(n, 0xD6E8FEB86659FD93, np.uint64)
        back = np.full(n, pow(0xD6E8FEB86659FD93, -1, 1 << 64), np.uint64)
        base[0] = back[0] = 1
        kept.update(n=n, up=np.multiply.accumulate(base), down=np.multiply.accumulate(back))
    return kept["up"], kept["down"]


def _piece(data: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word starts and hashes of one piece; ``fresh`` marks first bytes of texts."""
    space, value = process_cache("byte tables", _tables)
    is_space = space[data]
    begin = ~is_space
    begin[1:] &= is_space[:-1] | fresh[1:]
    at = np.flatnonzero(begin)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    up, down = _powers(len(data))
    sums = np.add.reduceat(value[data] * up[: len(data)], at)
    return at, mix(sums * down[at])


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, end to end, and the offsets of the texts; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of a column of texts, in order, and for each text (and the
    end) the number of words before it. Words are runs without ASCII white space, A-Z
    lower-cased; equal words have equal hashes."""
    data, offsets = raw_bytes(column)
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True
    places, hashes, at = [], [], 0
    space, _ = process_cache("byte tables", _tables)
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data):  # cut after white space only
            stretch = space[data[end : end + 4096]]
            if stretch.any():
                end += int(stretch.argmax()) + 1
                break
            end += len(stretch)
        start, hashed = _piece(data[at:end], fresh[at:end])
        places.append(start + at)
        hashes.append(hashed)
        at = end
    places = np.concatenate(places) if places else np.zeros(0, np.int64)
    hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return hashes, np.searchsorted(places, offsets)
