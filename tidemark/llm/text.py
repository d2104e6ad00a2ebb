"""Text helpers shared by the operators: whole batches as arrays of code points."""

from __future__ import annotations

import re
import sys
import unicodedata

import numpy as np

SPACE_RUN = re.compile(r"[^\S\n]+")
AROUND_BREAK = re.compile(r" ?\n ?")
DIGITS = re.compile(r"[0-9]+")
#: A word, or a single Han character.
WORD = re.compile(r"[㐀-鿿豈-﫿]|[^\W_㐀-鿿豈-﫿]+")

#: Multiplier of the polynomial hashes, arithmetic modulo 2^64.
PRIME = np.uint64(0x9E3779B97F4A7C15)


def codes(text: str) -> np.ndarray:
    """Code points of ``text``; lone surrogates, which no stored text should hold, pass as they are."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def spread_bits(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of each value (the finaliser of splitmix64)."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(c: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` values of ``c``, by doubling; len(c) - k + 1 of them."""
    n = len(c)
    if n < k:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        power, size, h = PRIME, 1, spread_bits(c.astype(np.uint64) + np.uint64(1))
        out, have, out_power = None, 0, np.uint64(1)
        while True:
            if k & size:
                out = h[: n - size + 1] if out is None else out[: n - have - size + 1] * power + h[have : n - size + 1]
                have += size
                out_power = out_power * power
            if have == k:
                return spread_bits(out)
            h = h[: n - 2 * size + 1] * power + h[size:]
            power, size = power * power, size * 2


def prefix_hashes(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums S and inverse powers such that any span has the hash (S[b] - S[a]) * inv[a]."""
    with np.errstate(over="ignore"):
        inverse = np.uint64(pow(int(PRIME), -1, 2**64))
        p = np.full(len(c) + 1, PRIME, dtype=np.uint64)
        p[0] = 1
        inv = np.full(len(c) + 1, inverse, dtype=np.uint64)
        inv[0] = 1
        p, inv = np.multiply.accumulate(p), np.multiply.accumulate(inv)
        s = np.zeros(len(c) + 1, dtype=np.uint64)
        np.cumsum(spread_bits(c.astype(np.uint64) + np.uint64(1)) * p[:-1], out=s[1:])
    return s, inv


def line_form(text: str) -> str:
    """``text`` with every line trimmed, inner white space one blank, case folded and digit runs as 0."""
    return DIGITS.sub("0", AROUND_BREAK.sub("\n", SPACE_RUN.sub(" ", text)).strip(" ")).casefold()


def char_class(points: list[int]) -> str:
    """A regular-expression class of sorted code points, as ranges."""
    out, i = [], 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        out.append(f"\\U{points[i]:08x}-\\U{points[j]:08x}")
        i = j + 1
    return "[" + "".join(out) + "]"


# Classes stay within the first plane, where a search looks up one table per character.
_COMPATIBLE = re.compile(char_class([c for c in range(0xA0, 0x10000) if not 0xD800 <= c < 0xE000 and not unicodedata.is_normalized("NFKC", chr(c))]) + "+")
BEYOND = re.compile("[\U00010000-\U0010ffff]")
_MARK = re.compile("[\u0300-\u036f]")


def compatible(s: str) -> str:
    """NFKC of ``s``, touching only what it changes."""
    if BEYOND.search(s):
        return unicodedata.normalize("NFKC", s)
    s = _COMPATIBLE.sub(lambda m: unicodedata.normalize("NFKC", m[0]), s)
    return unicodedata.normalize("NFC", s) if _MARK.search(s) else s


class Without:
    """Deletion of code points, with a quick look for texts that hold none."""

    def __init__(self, points: list[int]) -> None:
        self.table = dict.fromkeys(points)
        self.seen = re.compile(char_class(sorted(p for p in points if p < 0x10000)))

    def __call__(self, s: str) -> str:
        return s.translate(self.table) if self.seen.search(s) or BEYOND.search(s) else s
