"""Arrow-batched functions for what columns can't express."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from difflib import SequenceMatcher
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


class _Text(HTMLParser):
    """Text of a page with character references resolved; scripts, styles and comments are not text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def html_text(html: str | None) -> str | None:
    if not html:
        return None
    parser = _Text()
    parser.feed(html)
    parser.close()
    return "".join(parser.parts)


@F.pandas_udf(T.StringType())
def clean_html(html: pd.Series) -> pd.Series:
    """Null for null and empty."""
    return html.map(html_text, na_action="ignore")


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; it isn't symmetric."""
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def ratio_bound(a, b):
    """No ratio is higher than this: twice the shorter length over both lengths."""
    la, lb = F.char_length(a), F.char_length(b)
    return F.when(la + lb == 0, 1.0).otherwise(2.0 * F.least(la, lb) / (la + lb))


#: Classes of characters that are counted to bound a ratio, and pairs whose counts are compared at once.
CLASSES, PAIRS = 64, 1 << 14


def _counts(texts: list[str]) -> np.ndarray:
    """How often characters of each class occur in each text."""
    out = np.zeros((len(texts), CLASSES), np.int32)
    for i, t in enumerate(texts):
        out[i] = np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") % CLASSES, minlength=CLASSES)
    return out


def may_reach(a: list[str], b: list[str], threshold: float) -> np.ndarray:
    """False for pairs whose counts of characters show that their ratio is below ``threshold``."""
    out = np.empty(len(a), bool)
    for at in range(0, len(a), PAIRS):
        shared = lengths = 0
        sides = []
        for texts in (a[at : at + PAIRS], b[at : at + PAIRS]):
            codes, known = pd.factorize(np.array(texts, object))
            counts = _counts(list(known))
            sides.append(counts[codes])
            lengths = lengths + counts.sum(axis=1)[codes]
        shared = np.minimum(*sides).sum(axis=1)
        out[at : at + PAIRS] = (lengths == 0) | (2.0 * shared >= threshold * lengths - 1e-9)
    return out


def in_order(places: dict[str, int], size: int, a: str) -> int:
    """Length of the longest common subsequence of ``a`` with the text of ``size`` whose characters are at these places (bits)."""
    every = (1 << size) - 1
    row = every
    for c in a:
        met = row & places.get(c, 0)
        row = (row + met | row - met) & every
    return size - row.bit_count()


def ratio_at_least(threshold: float):
    """The ratio where it reaches ``threshold``, else null; cheaper bounds of it are tried first.

    What matches does so in order, so no ratio is higher than that of the longest common subsequence.
    """

    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out, matcher, places, now = np.full(len(a), np.nan), SequenceMatcher(None), {}, None
        known = np.flatnonzero((a.notna() & b.notna()).to_numpy())
        x_all, y_all = a.to_numpy(object)[known], b.to_numpy(object)[known]
        for i in np.flatnonzero(may_reach(x_all.tolist(), y_all.tolist(), threshold)).tolist():
            x, y = x_all[i], y_all[i]
            if y != now:
                now, places = y, {}
                for j, char in enumerate(y):
                    places[char] = places.get(char, 0) | 1 << j
            if x and y and 2.0 * in_order(places, len(y), x) / (len(x) + len(y)) < threshold:
                continue
            if y != matcher.b:
                matcher.set_seq2(y)  # what is counted of the second text serves all that follow
            matcher.set_seq1(x)
            found = matcher.ratio()
            if found >= threshold:
                out[known[i]] = found
        return pd.Series(out)

    return run


#: Bits of texts that another text is compared with at once, and bytes of results that are looked at together.
PACK_BITS, LOOK_BYTES = 1 << 13, 1 << 22


def _folded(text: str) -> bytes:
    """Characters in 256 classes, which can only lengthen what texts have in common."""
    return (np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") % 256).astype(np.uint8).tobytes()


class Pack:
    """Texts side by side in one long row of bits, so that a step of ``in_order`` serves them all.

    Behind each text lie whole bytes that count what its additions carry over, which is its subsequence's length.
    """

    def __init__(self, texts: list[str]):
        sizes = np.array([len(t) for t in texts])
        self.width = (int(sizes.max()).bit_length() + 7) // 8
        self.ends = np.cumsum(-(-sizes // 8) + self.width) - self.width
        self.bytes = int(self.ends[-1]) + self.width
        codes = np.full(8 * self.bytes, 256, np.uint16)
        for text, size, end in zip(texts, sizes.tolist(), (8 * self.ends).tolist()):
            codes[end - size : end] = np.frombuffer(_folded(text), np.uint8)
        bits = lambda met: int.from_bytes(np.packbits(met, bitorder="little").tobytes(), "little")
        self.every = bits(codes < 256)
        self.places = {c: (places, self.every ^ places) for c in np.unique(codes).tolist() if c < 256 for places in [bits(codes == c)]}
        self.others = bytes(c for c in range(256) if c not in self.places)

    def common(self, folded: list[bytes]) -> np.ndarray:
        """Longest common subsequence of each folded text (rows) with each of the pack's texts (columns), or more."""
        found, places = bytearray(), self.places
        for text in folded:
            row = self.every
            for c in text.translate(None, self.others):
                here, elsewhere = places[c]
                row = row + (row & here) | row & elsewhere
            found += row.to_bytes(self.bytes, "little")
        counts = np.frombuffer(found, np.uint8).reshape(len(folded), self.bytes)
        return sum((counts[:, self.ends + k].astype(np.int64) << 8 * k for k in range(self.width)), np.zeros((len(folded), len(self.ends)), np.int64))


def alike_pairs(many: list[str], few: list[str], threshold: float, few_first: bool) -> Iterator[tuple[int, int, float]]:
    """Places in both lists and ratio of all pairs of texts at ``threshold`` or more; ``few_first`` makes the second list's text the first of the ratio.

    The exact ratio is taken only of pairs whose longest common subsequence allows it.
    """
    many_at, few_at = (sorted(range(len(x)), key=lambda i, x=x: len(x[i])) for x in (many, few))
    folded, sizes = [_folded(many[i]) for i in many_at], np.array([len(many[i]) for i in many_at], np.int64)
    widest, matcher, start = (2 - threshold) / threshold, SequenceMatcher(None), 0
    while start < len(few_at):
        stop, held = start, 0
        while stop < len(few_at) and (stop == start or held + len(few[few_at[stop]]) <= PACK_BITS):
            held += len(few[few_at[stop]])
            stop += 1
        some, start = few_at[start:stop], stop
        own = np.array([len(few[j]) for j in some], np.int64)
        low, high = np.searchsorted(sizes, [own[0] / widest - 1, own[-1] * widest + 1]).tolist()
        if low == high:
            continue
        pack = Pack([few[j] for j in some])
        step = max(1, LOOK_BYTES // max(1, pack.bytes))
        for at in range(low, high, step):
            upto = min(at + step, high)
            both = sizes[at:upto, None] + own
            near = 2.0 * pack.common(folded[at:upto]) >= threshold * both - 1e-9
            for k, j in zip(*(x.tolist() for x in np.nonzero(near.T))):
                one, two = many[many_at[at + j]], few[some[k]]
                x, y = (two, one) if few_first else (one, two)
                if y != matcher.b:
                    matcher.set_seq2(y)  # what is counted of the second text serves all that follow
                matcher.set_seq1(x)
                found = matcher.ratio()
                if found >= threshold:
                    yield many_at[at + j], some[k], found


def mock_vector(text: str | None, dim: int) -> np.ndarray:
    seed = int.from_bytes(hashlib.sha256((text or "").encode()).digest()[:8], "big")
    v = np.random.default_rng(seed).normal(size=dim)
    return (v / np.linalg.norm(v)).astype(np.float32)


def mock_embedding(dim: int = 64):
    """Unit vectors drawn from a generator seeded with the text's SHA-256: the same text, the same vector."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(text: pd.Series) -> pd.Series:
        return pd.Series([mock_vector(t, dim) for t in text])

    return embed
