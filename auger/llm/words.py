"""Words and word shingles of whole texts as 64-bit hashes, computed in numpy for many texts at once.

A word is a maximal run of letters, digits, marks and underscores, compared in lower case. Its hash is
a polynomial over its code points, taken from prefix sums (wrapping 64-bit arithmetic) and mixed; it
depends on the word alone. A shingle is ``k`` words in a row; a text of fewer words has one shingle of
all its words, a text without words none. Null texts count as empty. Long texts are cut between words,
so memory follows ``CHUNK`` and the number of words, not the characters of the longest text times the
temporaries.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

CHUNK = 1_000_000  # characters handled at once
_TABLE = 0x20000  # code points above it are letters without case
_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_B_INV = np.uint64(pow(int(_B), -1, 2 ** 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(_TABLE, dtype=np.uint32)
    word = np.zeros(_TABLE, dtype=bool)
    for i in range(_TABLE):
        c = chr(i)
        word[i] = c.isalnum() or c == "_" or unicodedata.category(c)[0] == "M"
        low = c.lower()
        if len(low) == 1:
            lower[i] = ord(low)
    return lower, word


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _B, dtype=np.uint64), np.full(n, _B_INV, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def fold(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points, and whether each belongs to a word."""
    lower, word = _tables()
    at = np.minimum(codes, _TABLE - 1)
    high = codes >= _TABLE
    return np.where(high, codes, lower[at]), word[at] | high


def _span_hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = 1 << max(16, int(len(low)).bit_length())
    up, down = _powers(n)
    run = np.zeros(len(low) + 1, dtype=np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(low)], out=run[1:])
    return mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64))


def _pieces(texts: list[str | None]):
    """Yield (joined text, [(text number, first character in the text, first in the piece, length)])."""
    buf, parts, size = [], [], 0
    for i, t in enumerate(texts):
        t = t or ""
        at = 0
        while True:
            room = CHUNK - size
            if len(t) - at > room:
                cut = at + room
                if size and len(t) - at <= CHUNK:
                    cut = at  # fits whole into the next piece
                while cut > at and (t[cut - 1].isalnum() or t[cut - 1] == "_" or unicodedata.category(t[cut - 1])[0] == "M"):
                    cut -= 1
                if cut == at and not size:  # one word longer than a piece: take all of it
                    cut = at + room
                    while cut < len(t) and not t[cut].isspace():
                        cut += 1
            else:
                cut = len(t)
            buf.append(t[at:cut])
            parts.append((i, at, size, cut - at))
            size += cut - at + 1
            at = cut
            if at >= len(t):
                break
            yield "\n".join(buf), parts
            buf, parts, size = [], [], 0
        if size >= CHUNK:
            yield "\n".join(buf), parts
            buf, parts, size = [], [], 0
    if parts:
        yield "\n".join(buf), parts


class Words:
    """The words of several texts: ``hash``; ``start`` and ``end`` (characters in the text); text ``i``
    has the words ``off[i]`` to ``off[i + 1]``. With ``kinds``: ``number`` (starts with a digit) and
    ``name`` (a capital and a small letter begin it, and no sentence or line starts there). ``prefix``:
    for each asked length the hashes of the words' beginnings (of the word, where that is shorter)."""

    def __init__(self, texts: list[str | None], kinds: bool = False, prefixes: tuple[int, ...] = ()):
        out: dict[str, list[np.ndarray]] = {k: [] for k in ("hash", "start", "end", "text", "number", "name", *prefixes)}
        for joined, parts in _pieces(texts):
            codes = code_points(joined)
            low, word = fold(codes)
            edge = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
            start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            begins = np.array([p[2] for p in parts])
            part = np.searchsorted(begins, start, side="right") - 1
            shift = np.array([p[1] - p[2] for p in parts], dtype=np.int64)[part] if len(start) else start
            out["hash"].append(_span_hashes(low, start, end))
            for p in prefixes:
                out[p].append(_span_hashes(low, start, np.minimum(end, start + p)))
            out["start"].append(start + shift)
            out["end"].append(end + shift)
            out["text"].append(np.array([p[0] for p in parts], dtype=np.int64)[part] if len(start) else start)
            if kinds and len(start):
                first = codes[start]
                out["number"].append((first >= 48) & (first <= 57))
                stops = np.cumsum(np.isin(codes, _STOPS))
                before = np.concatenate(([1], (stops[start[1:]] - stops[end[:-1] - 1]) > 0)).astype(bool)
                second = np.minimum(start + 1, len(codes) - 1)
                title = (low[start] != first) & (end - start > 1) & (low[second] == codes[second])
                out["name"].append(title & ~before & (np.diff(part, prepend=-1) == 0))
        join = {k: np.concatenate(v) if v else np.empty(0, dtype=np.int64) for k, v in out.items()}
        self.hash = join["hash"].astype(np.uint64)
        self.start, self.end = join["start"], join["end"]
        self.number, self.name = join["number"].astype(bool), join["name"].astype(bool)
        self.prefix = {p: join[p].astype(np.uint64) for p in prefixes}
        self.off = np.searchsorted(join["text"], np.arange(len(texts) + 1))


_STOPS = np.array([ord(c) for c in ".!?:\n\r\"([|"], dtype=np.uint32)


def shingles(hashes: np.ndarray, off: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``k``-word shingles of each text, in order of place, and their offsets by text."""
    n = np.diff(off)
    ns = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    soff = np.concatenate(([0], np.cumsum(ns)))
    total = int(soff[-1])
    if not total:
        return np.empty(0, dtype=np.uint64), soff
    first = np.repeat(off[:-1] - soff[:-1], ns) + np.arange(total)
    width = np.repeat(np.minimum(n, k), ns)
    acc = width.astype(np.uint64)
    last = len(hashes) - 1
    for j in range(k):
        h = hashes[np.minimum(first + j, last)] * _ODD[j % len(_ODD)]
        acc = mix(acc ^ np.where(j < width, h, np.uint64(0))) if j == k - 1 else acc * _ODD[-1] + np.where(j < width, h, np.uint64(0))
    return acc, soff


_ODD = mix(np.arange(1, 9, dtype=np.uint64)) | np.uint64(1)


def repeats_by_text(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each text, ascending, and their offsets."""
    if not len(values):
        return values, np.zeros_like(off)
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    keep = np.concatenate(([True], (v[1:] != v[:-1]) | (o[1:] != o[:-1])))
    v, o = v[keep], o[keep]
    return v, np.searchsorted(o, np.arange(len(off)))


def text_batches(rows, chars: int = 1_500_000):
    """Cut an Arrow batch with a ``text`` column into slices of about ``chars`` bytes of text."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(rows.column("text")), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(size)
    at = 0
    while at < len(size):
        base = run[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(run, base + chars, side="right")))
        yield rows.slice(at, to - at)
        at = to
