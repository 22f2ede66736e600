"""Arrow string columns as flat code point arrays: small vectorised helpers for use inside tasks."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

_BMP = 0x10000


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all values on end, offsets of the values); a null is an empty value."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    column = column.fill_null("") if column.null_count else column
    n = len(column)
    off = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = bytes(data[off[0] : off[-1]]) if n and data is not None else b""
    points = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return points, starts[off - off[0]]


@cache
def _lower_table() -> np.ndarray:
    return np.array([ord(c.lower()) if len(c.lower()) == 1 else i for i, c in enumerate(map(chr, range(_BMP)))], np.uint32)


@cache
def _class_table() -> np.ndarray:
    """1 letter or mark, 2 digit, 4 white space, 8 letter of a script without blanks (Han, Kana), 16 invisible."""
    import unicodedata

    t = np.zeros(_BMP, np.uint8)
    for i in range(_BMP):
        c = chr(i)
        k = unicodedata.category(c)[0]
        t[i] = 1 if k in "LM" else 2 if k == "N" else 4 if c.isspace() else 16 if unicodedata.category(c) in ("Cf", "Cc") else 0
    for lo, hi in ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9D)):
        t[lo : hi + 1] |= (t[lo : hi + 1] & 1) << 3
    return t


def lowered(points: np.ndarray) -> np.ndarray:
    """Code points in lower case, one for one; where lower case is longer the letter stays."""
    if not len(points) or points.max() < _BMP:
        return _lower_table()[points]
    return np.where(points < _BMP, _lower_table()[np.minimum(points, _BMP - 1)], points).astype(np.uint32)


def classes(points: np.ndarray) -> np.ndarray:
    """Class bits of each code point; ideographs beyond the basic plane are letters without blanks."""
    if not len(points) or points.max() < _BMP:
        return _class_table()[points]
    beyond = points >= _BMP
    out = _class_table()[np.where(beyond, 0, points)]
    out[beyond] = np.where((points[beyond] >= 0x20000) & (points[beyond] < 0x32000), 9, 0)
    return out


@cache
def _members(chars: str) -> np.ndarray:
    t = np.zeros(_BMP, bool)
    t[[ord(c) for c in chars]] = True
    return t


def is_in(points: np.ndarray, chars: str) -> np.ndarray:
    """True where a code point is one of ``chars``, all of the basic plane and none its last."""
    return _members(chars)[np.minimum(points, _BMP - 1)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixing one-to-one function of uint64 values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_P = 0x9E3779B97F4A7C15 | 1


@cache
def _mixed_points() -> np.ndarray:
    return mixed(np.arange(_BMP, dtype=np.uint64) + np.uint64(0x51ED27))


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the hash's base and of its inverse, kept for the next call."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, n.bit_length())
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, base, np.uint64))]) for base in (_P, pow(_P, -1, 1 << 64))]
    return _powers[0], _powers[1]


def prefix_sums(points: np.ndarray) -> np.ndarray:
    """What ``span_hashes`` needs to know of the code points, to be made once for several calls."""
    if not len(points) or points.max() < _BMP:
        values = _mixed_points()[points]
    else:
        values = mixed(points.astype(np.uint64) + np.uint64(0x51ED27))
    powers, _ = _power_tables(len(points) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers[: len(points)], dtype=np.uint64)])


def span_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each span of code points, equal for equal spans wherever they are."""
    sums = prefix_sums(points) if sums is None else sums
    _, inverses = _power_tables(len(points) + 1)
    return mixed((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))
