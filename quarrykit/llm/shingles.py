"""Word shingles as 64-bit numbers.

A word is its 128-bit XXH3 hash, two numbers; a shingle is the sum of its words' first numbers, each times an odd number of its place, then mixed.
Two different shingles get the same number with a chance under 2 ** -60, whatever their letters (XXH3 has no structure that
particular letters could defeat, unlike a polynomial); a set of n shingles counts one too few with a chance under n ** 2 / 2 ** 61.
The second numbers make a second lane, which goes into a set's 128-bit key only.
"""

from __future__ import annotations

import hashlib

import numpy as np
from xxhash import xxh3_128_digest

SIZE = 5
#: A-Z as a-z; all other bytes as they are.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
EMPTY = np.zeros(0, np.uint64)
#: An odd number for each lane and place. No two of a lane are equal modulo 32, so that words that change places are told apart (2 ** -60).
PLACES = np.frombuffer(hashlib.blake2b(b"places", digest_size=40).digest() + hashlib.blake2b(b"more places", digest_size=40).digest(), np.uint64).reshape(2, SIZE) | np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _words(text: str | None) -> np.ndarray:
    """Both numbers of each word, a column for each word."""
    # bytes.split() cuts at runs of 0x20 and 0x09 to 0x0D, and at nothing else
    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    return np.ascontiguousarray(np.frombuffer(b"".join(map(xxh3_128_digest, words)), np.uint64).reshape(-1, 2).T)


def _lane(word: np.ndarray, lane: int) -> np.ndarray:
    n, short = max(1, len(word) - SIZE + 1), min(SIZE, len(word))
    with np.errstate(over="ignore"):
        h = word[:n] * PLACES[lane, 0]
        for k in range(1, short):
            h += word[k : n + k] * PLACES[lane, k]
        return mixed(h + np.uint64(short))


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct five-word shingles, sorted. Fewer words: the whole sequence is one. No word or null: empty."""
    return shingle_set_and_key(text)[0]


def shingle_set_and_key(text: str | None) -> tuple[np.ndarray, bytes | None]:
    """(the set, 128 bits that name it, made of both lanes); the key of an empty set is None."""
    one, two = _words(text)
    if not len(one):
        return EMPTY, None
    h = _lane(one, 0)
    order = np.argsort(h)
    h = h[order]
    new = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    if not new.all():
        h, order = h[new], order[new]
    key = hashlib.blake2b(h, digest_size=16)
    key.update(_lane(two, 1)[order])
    return h, key.digest()
