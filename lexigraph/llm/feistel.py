"""Keyed permutations of any range of numbers: a balanced Feistel network on the next even number of bits, walked along its cycle
until it falls into the range again."""

from __future__ import annotations

import hashlib

import numpy as np


def _round(key: bytes, tweak: bytes, k: int, x: int, half: int) -> int:
    size = (half + 7) // 8
    digest = hashlib.blake2b(k.to_bytes(1) + tweak + b"/" + x.to_bytes(size), digest_size=min(64, max(8, size)), key=key[:64]).digest()
    return int.from_bytes(digest) & ((1 << half) - 1)


def permute(x: int, size: int, key: bytes, tweak: bytes = b"", rounds: int = 10, back: bool = False) -> int:
    """Where the permutation of range(size) takes x (or, `back`, what it takes to x). One or no value stays as it is."""
    if size < 2:
        return x
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    if half > 512:
        raise ValueError("ranges of more than 1024 bits aren't handled")
    mask = (1 << half) - 1
    while True:
        a, b = x >> half, x & mask
        for k in range(rounds - 1, -1, -1) if back else range(rounds):
            if back:
                a, b = b ^ _round(key, tweak, k, a, half), a
            else:
                a, b = b, a ^ _round(key, tweak, k, b, half)
        x = a << half | b
        if x < size:
            return x


def permute_array(x: np.ndarray, size: int, key: int, rounds: int = 6, back: bool = False) -> np.ndarray:
    """The same idea for many 63-bit numbers at once, with a multiplicative mixer for the round function: for shuffling, not for
    secrecy."""
    x = x.astype(np.uint64)
    if size < 2:
        return x.astype(np.int64)
    half = np.uint64(max(1, ((size - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = np.frombuffer(hashlib.blake2b(key.to_bytes(16, signed=True), digest_size=8 * rounds).digest(), np.uint64)
    todo = np.arange(len(x))
    with np.errstate(over="ignore"):

        def mixed(v: np.ndarray, k: np.uint64) -> np.ndarray:
            v = (v ^ k) * np.uint64(0x9E3779B97F4A7C15)
            v = (v ^ (v >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            return (v ^ (v >> np.uint64(29))) & mask

        while len(todo):
            a, b = x[todo] >> half, x[todo] & mask
            for k in keys[::-1] if back else keys:
                a, b = (b ^ mixed(a, k), a) if back else (b, a ^ mixed(b, k))
            x[todo] = a << half | b
            todo = todo[x[todo] >= np.uint64(size)]
    return x.astype(np.int64)
