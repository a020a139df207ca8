"""Vectorised word tables for one block of documents (NumPy, inside tasks).

A block is a bounded list of UTF-8 texts.  Word boundaries are ASCII bytes in
every contract used here, so words are found on bytes without decoding.  A word
is known by a 64-bit digest: the sum over its 8-byte chunks of a bijective mix
of chunk, position and salt.  Digests of different salts are independent, so
callers that compare words or windows by digest carry two (128 bits).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are not part of a word: space and \x09-\x0D.
SPACE = np.ones(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes that are part of a lower-cased alphanumeric word: 0-9, a-z, non-ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_M = 0xD1342543DE82EF95
_STEP = 1 << 20
_CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """M**i and M**-i modulo 2**64 for i < n (cached, grown on demand)."""
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, _STEP)
        for name, base in (("up", _M), ("down", pow(_M, -1, 1 << 64))):
            grown = np.full(size, base, dtype=np.uint64)
            grown[0] = 1
            _POWERS[name] = np.multiply.accumulate(grown)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Bijective 64-bit finaliser; ``salt`` gives independent looking variants."""
    h = h + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def span_hash(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of codes[s:e] for each (s, e): prefix sums of codes scaled by M**-i."""
    up, down = powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * down[: len(codes)], out=total[1:])
    return (total[ends] - total[starts]) * up[starts]


def word_digest(raw: bytes, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit digest of raw[s:e] for each (s, e), not linear in the bytes.

    Every 8-byte chunk is mixed with its number and the salt before the chunks
    are summed, so no exchange or shift of bytes cancels out as it may in a
    polynomial hash modulo 2**64.
    """
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    padded = raw + b"\0" * 8
    eight = np.ndarray(len(raw) + 1, dtype="<u8", buffer=padded, strides=(1,))
    size = ends - starts
    out = np.empty(len(starts), dtype=np.uint64)
    long = np.flatnonzero(size > 8)
    keep = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
    out[:] = mix((eight[starts] & keep[np.minimum(size, 8)]) ^ mix(np.zeros(1, np.uint64), 2 * salt + 3))
    if len(long):
        chunks = (size[long] + 7) // 8 - 1  # after the first
        first = np.cumsum(chunks) - chunks
        word = np.repeat(np.arange(len(long)), chunks)
        number = np.arange(len(word)) - first[word] + 1
        at = starts[long][word] + 8 * number
        left = np.minimum(ends[long][word] - at, 8)
        mixed = mix((eight[at] & keep[left]) ^ mix(number.astype(np.uint64), 2 * salt + 3))
        out[long] += np.add.reduceat(mixed, first)
    return mix(out + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 2 * salt + 4)


@dataclass
class Words:
    """Words of a list of texts; word i of document d has index first[d] + i."""

    raw: bytes
    doc_start: np.ndarray  # byte offset of each text in raw
    starts: np.ndarray  # byte offsets of words
    ends: np.ndarray
    first: np.ndarray  # n_docs + 1 word offsets
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def window_starts(self, size: int) -> np.ndarray:
        """Word indexes at which ``size`` words of one document begin."""
        n = len(self.hashes)
        if n < size:
            return np.zeros(0, dtype=np.int64)
        limit = np.repeat(self.first[1:], self.counts)
        at = np.arange(n, dtype=np.int64)
        return at[at + size <= limit]

    def digest(self, salt: int) -> np.ndarray:
        """Digests of the words, independent of ``hashes`` for any salt but 0."""
        return word_digest(self.raw, self.starts, self.ends, salt)

    def window_hash(self, starts: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
        codes = mix(self.hashes, salt) if salt else self.hashes
        return mix(span_hash(codes, starts, starts + size), salt)

    def second_hash(self, starts: np.ndarray, size: int) -> np.ndarray:
        """Window hashes over other digests of the words than those of ``window_hash``."""
        return mix(span_hash(self.digest(1), starts, starts + size), 1)


def word_table(texts: list[bytes], letters: np.ndarray = SPACE, lower: bool = False) -> Words:
    """Words of each text: longest runs of bytes of one class above 0 in ``letters``.

    A boolean ``letters`` marks the bytes that words consist of.
    """
    raw = b" ".join(texts)
    if lower:
        raw = raw.lower()  # bytes.lower() changes A-Z only
    buf = np.frombuffer(raw, dtype=np.uint8)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    doc_start = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1].astype(np.int64)
    kind = np.zeros(len(buf) + 2, dtype=np.uint8)
    kind[1:-1] = letters[buf]
    edges = np.flatnonzero(kind[1:] != kind[:-1])
    starts, ends = edges[kind[edges + 1] > 0], edges[kind[edges] > 0]
    hashes = word_digest(raw, starts, ends)
    first = np.searchsorted(starts, np.append(doc_start, len(buf) + 1)).astype(np.int64)
    return Words(raw, doc_start, starts, ends, first, hashes)


def covered(n: int, starts: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Mask of 0..n-1 lying in any [start, start + size)."""
    begins = np.bincount(starts, minlength=n + 1)
    begins -= np.bincount(np.minimum(starts + size, n), minlength=n + 1)
    return np.cumsum(begins[:-1]) > 0


def join_parts(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def split_parts(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def pack_bits(mask: np.ndarray) -> bytes:
    return np.packbits(mask).tobytes()


def unpack_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def pack(values: np.ndarray, increasing: bool = False) -> bytes:
    """Unsigned integers as Zstandard-compressed byte planes (differences if increasing)."""
    values = values.astype(np.uint64)
    if increasing and len(values):
        values = np.diff(values, prepend=np.uint64(0))
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(data: bytes, increasing: bool = False) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = pa.decompress(data[8:], decompressed_size=8 * n, codec="zstd", asbytes=True)
    values = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(values, dtype=np.uint64) if increasing else values


def batch_slices(sizes: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Cut consecutive rows into slices of at most ``limit`` bytes (one row at least)."""
    out, begin, held = [], 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            out.append((begin, i))
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        out.append((begin, len(sizes)))
    return out


def text_slices(column: pa.Array, limit: int = 4 << 20):
    """Yield (begin, end, texts as bytes; null as empty) over an Arrow string column."""
    binary = column.cast(pa.binary())
    sizes = np.array(pc.fill_null(pc.binary_length(binary), 0))
    for begin, end in batch_slices(sizes, limit):
        yield begin, end, [x or b"" for x in binary.slice(begin, end - begin).to_pylist()]
