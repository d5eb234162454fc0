"""Words of letters, digits and characters beyond ASCII, with A-Z lower-cased, as bytes; and what is hashed from them."""

from __future__ import annotations

import zlib

import numpy as np

#: The words' pattern, for SQL and for expressions: runs of 0-9, a-z and everything beyond ASCII.
PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Each byte of UTF-8 as it stands in a word; a blank where none can stand.
_TABLE = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """The words of a text; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def checksums(found: list[bytes]) -> np.ndarray:
    """The CRC-32 of each word."""
    return np.fromiter(map(zlib.crc32, found), np.uint32, len(found))


#: Odd multipliers of 64 bits (fixed values) for the places of a run of words.
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def run_hashes(sums: np.ndarray, size: int) -> np.ndarray:
    """A hash of 64 bits (as int64) for every run of `size` consecutive words, at most four, from the words' checksums."""
    n = len(sums) - size + 1
    if n <= 0:
        return np.empty(0, np.int64)
    wide = sums.astype(np.uint64)
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = (out ^ wide[k : k + n]) * _MULTIPLIERS[k]
        out ^= out >> np.uint64(29)
    return out.view(np.int64)
