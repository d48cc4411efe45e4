"""Blocks that ask how many rows of a table have each of their hashes, in an exchange()."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import zstandard

from .exchange import Entries
from .wordhash import mix


def squeezed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def planes(*arrays: np.ndarray) -> bytes:
    """Numbers by their bytes' places, which compress better; the first array as differences."""
    return np.int64(len(arrays[0])).tobytes() + b"".join(np.ascontiguousarray(np.asarray(x, "<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for x in (np.diff(arrays[0], prepend=0), *arrays[1:]))


def numbers(data: bytes, arrays: int) -> tuple[list[np.ndarray], bytes]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    out = [np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * n, 8 + 8 * n * k).reshape(8, -1).T).view("<i8").ravel() for k in range(arrays)]
    out[0] = np.cumsum(out[0])
    return out, data[8 + 8 * n * arrays :]


def places(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Each hash's bucket, and the 32 bits that tell it from others there. Two hashes that share both merely count together."""
    h = mix(hashes)
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), (mix(h ^ np.uint64(1)) >> np.uint64(32)).astype(np.int64)


def lots(keys: np.ndarray) -> list[np.ndarray]:
    """The places of each key, keys rising."""
    order = np.argsort(keys, kind="stable")
    return [x for x in np.split(order, np.flatnonzero(np.diff(keys[order])) + 1) if len(x)]


def asked(hashes: np.ndarray, rows: np.ndarray, buckets: int) -> Entries:
    """What a block asks the buckets: its distinct hashes, sorted, and how many of its rows have each."""
    bucket, bits = places(hashes, buckets)
    out = []
    for own in lots(bucket):
        own = own[np.argsort(bits[own], kind="stable")]
        out.append((int(bucket[own[0]]), squeezed(planes(bits[own], rows[own]))))
    return out


def replier(code: Callable[[np.ndarray], np.ndarray]):
    """A bucket's answers: the code, a byte, of the sum of all blocks' rows, in the order asked."""

    def reply(bucket: int, entries: Entries) -> Entries:
        told = [numbers(zstandard.decompress(data), 2)[0] for _, data in entries]
        _, number = np.unique(np.concatenate([t[0] for t in told]), return_inverse=True)
        said = code(np.bincount(number, weights=np.concatenate([t[1] for t in told]))[number]).astype(np.uint8)
        ends = np.cumsum([len(t[0]) for t in told])
        return [(block, squeezed(part.tobytes())) for (block, _), part in zip(entries, np.split(said, ends[:-1]), strict=True)]

    return reply


def replies(hashes: np.ndarray, answers: Entries, buckets: int) -> np.ndarray:
    """The codes of the hashes that a block asked for."""
    bucket, bits = places(hashes, buckets)
    said, by = np.zeros(len(hashes), np.uint8), dict(answers)
    for own in lots(bucket):
        own = own[np.argsort(bits[own], kind="stable")]
        said[own] = np.frombuffer(zstandard.decompress(by[int(bucket[own[0]])]), np.uint8)
    return said
