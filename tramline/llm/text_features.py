"""Hash buckets of words and binned structure statistics, as inputs of the factorisation machines."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np

from tramline.llm.shared import worker_state

BUCKETS = 1 << 22
_EDGES = ".,;:!?\"'()[]{}<>#$%&*|-_«»“”‘’¿¡"
MEMO_ENTRIES = 300_000

#: Class of each code point below 65536: 1 upper, 2 lower or other letter, 3 digit, 4 blank, 5 line end, 6 other.
_CLASS = np.fromiter(((1 if c.isupper() else 2 if c.isalpha() else 3 if c.isdigit() else 5 if c == "\n" else 4 if c.isspace() else 6) for c in map(chr, range(1 << 16))), np.uint8, 1 << 16)


def bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % BUCKETS


def _of_word(word: str, prefix: int) -> tuple[int, ...]:
    bare = word.strip(_EDGES)
    if not bare:
        return (bucket("s:" + word[:3]),)
    return (bucket("w:" + bare),) if len(bare) <= prefix else (bucket("w:" + bare), bucket("p:" + bare[:prefix]))


def word_buckets(text: str, prefix: int = 5) -> set[int]:
    """Of the distinct lower-cased words, without marks at their edges, and of their first ``prefix`` letters."""
    words = set(text.lower().split())
    memo: dict[str, tuple[int, ...]] = worker_state("words", dict)
    if len(memo) > MEMO_ENTRIES:
        memo.clear()
    out: set[int] = set()
    for word in words:
        known = memo.get(word)
        if known is None:
            known = _of_word(word, prefix)
            if len(word) < 60:
                memo[word] = known
        out.update(known)
    return out


def _bin(name: str, value: float) -> int:
    """Bin of a share from 0 to 1, finer near both ends."""
    value = min(max(value, 0.0), 1.0)
    odds = math.log((value + 1e-3) / (1 - value + 1e-3))
    return bucket(f"b:{name}:{round(odds * 1.5)}")


def structure_buckets(text: str, n_chars: int | None) -> set[int]:
    """Binned statistics of a text's make-up: letters, marks, repetition, lines, length; and the recorded length."""
    n = len(text)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.bincount(_CLASS[np.minimum(codes, 65_535)], minlength=7) if n else np.zeros(7, int)
    letters = int(kinds[1] + kinds[2])
    words = text.split()
    counts = Counter(words)
    m = len(words)
    twins = sum(map(str.__eq__, words, words[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    ends = sum(w[-1] in ".,;:?!\"')" for w in words)
    marked = sum(not (w[-1].isalnum() or w[-1] in ".,;:?\"')") for w in words)
    pairs = Counter(zip(words, words[1:], strict=False))
    out = {
        _bin("upper", kinds[1] / max(1, letters)),
        _bin("letters", letters / max(1, n)),
        _bin("digits", kinds[3] / max(1, n)),
        _bin("marks", kinds[6] / max(1, n)),
        _bin("distinct", len(counts) / max(1, m)),
        _bin("top", max(counts.values(), default=0) / max(1, m)),
        _bin("twins", twins / max(1, m - 1)),
        _bin("pairs", 1 - len(pairs) / max(1, m - 1)),
        _bin("lines", len(lines) / max(1, m)),
        _bin("copies", 1 - len(set(lines)) / max(1, len(lines))),
        _bin("ends", ends / max(1, m)),
        _bin("marked", marked / max(1, m)),
        bucket(f"n:words:{round(math.log2(m + 1))}"),
        bucket(f"n:mean:{round(sum(map(len, words)) / max(1, m))}"),
        bucket(f"n:long:{round(math.log2(max(map(len, words), default=0) + 1))}"),
    }
    out.add(bucket("n:chars:none" if n_chars is None else f"n:chars:{round(math.log2(max(0, n_chars) + 1))}"))
    return out
