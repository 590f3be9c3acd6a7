"""Token counts (operator 3): rank-synchronous merging over ragged arrays.

Texts are cut at ASCII white space. A distinct piece is normalised and split into pre-tokens once
in a task; the pre-tokens of a batch lie one after the other in a flat symbol array, and in every
round each sequence merges all places of its own lowest-rank pair at the same time.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.llm.common import freeing, small_batches, table
from canvass.llm.vocab import byte_symbols, read_json

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
#: Distinct pieces remembered in a task before it forgets them all.
REMEMBERED = 1_000_000
_NONE = np.iinfo(np.int64).max


class MergeTable:
    """The merges of a vocabulary as sorted arrays: pair keys, their ranks and results."""

    def __init__(self, spec: dict):
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or level["type"] != "ByteLevel" or level["use_regex"]:
            raise ValueError("not a lower-casing byte-level BPE vocabulary with word ends")
        ids, end = model["vocab"], model["end_of_word_suffix"]
        self.pattern, self.size = split["pattern"]["Regex"], max(ids.values()) + 1
        symbols = byte_symbols()
        self.inner = np.array([ids[symbols[b]] for b in range(256)], np.int64)
        self.last = np.array([ids[symbols[b] + end] for b in range(256)], np.int64)
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        keys = np.array([ids[a] * self.size + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)[order]
        self.specials = [t["content"] for t in spec["added_tokens"]]


def merge_counts(words: list[bytes], merges: MergeTable) -> np.ndarray:
    """Number of symbols that survive the merges in each (non-empty) word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    counts = lengths.copy()
    flat = np.frombuffer(b"".join(words), np.uint8)
    owner = np.repeat(np.arange(len(words)), lengths)
    final = np.cumsum(lengths) - 1
    sym = merges.inner[flat]
    sym[final] = merges.last[flat[final]]
    while len(sym) > 1:
        key = sym[:-1] * merges.size + sym[1:]
        at = np.minimum(np.searchsorted(merges.keys, key), len(merges.keys) - 1)
        known = (merges.keys[at] == key) & (owner[:-1] == owner[1:])
        rank = np.append(np.where(known, merges.ranks[at], _NONE), _NONE)
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        low = np.minimum.reduceat(rank, first)
        size = np.diff(np.append(first, len(sym)))
        live = low != _NONE
        counts[owner[first[~live]]] = size[~live]
        hit = rank == np.repeat(low, size)
        hit &= rank != _NONE
        # Of overlapping places (a run of one symbol) every other one merges, from the left.
        begins = hit & ~np.append(False, hit[:-1])
        start = np.maximum.accumulate(np.where(begins, np.arange(len(hit)), 0))
        hit &= (np.arange(len(hit)) - start) % 2 == 0
        place = np.flatnonzero(hit)
        sym[place] = merges.made[at[place]]
        stays = np.repeat(live, size)
        stays[place + 1] = False
        sym, owner = sym[stays], owner[stays]
    if len(sym):
        counts[owner] = 1
    return counts


class Counter:
    """Counts tokens of texts; one for each task."""

    def __init__(self, merges: MergeTable):
        self.merges, self.words, self.pieces = merges, {}, {}
        self.find = regex.compile(merges.pattern).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(merges.specials, key=len, reverse=True)))) if merges.specials else None

    def _pretokens(self, piece: str) -> list[bytes]:
        # Lower case is by code point: no rule looks at the letters around.
        text = unicodedata.normalize("NFC", piece)
        text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        return [w.encode("utf-8", "surrogatepass") for w in self.find(text)]

    def _learn(self, pieces: Iterable[bytes]) -> None:
        split: list[tuple[bytes, int, list[bytes]]] = []
        for piece in pieces:
            text = piece.decode("utf-8", "surrogatepass")
            parts, extra = [text], 0
            if self.special and "<|" in text:
                extra = len(self.special.findall(text))
                parts = self.special.split(text)
            split.append((piece, extra, [w for p in parts for w in self._pretokens(p)]))
        fresh = list({w for _, _, found in split for w in found} - self.words.keys())
        if fresh:
            self.words.update(zip(fresh, merge_counts(fresh, self.merges).tolist()))
        for piece, extra, found in split:
            self.pieces[piece] = extra + sum(map(self.words.__getitem__, found))

    def count(self, texts: Iterable[bytes]) -> list[int]:
        cut = [t.split() for t in texts]
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
            self.words.clear()
        fresh = set().union(*cut) - self.pieces.keys() if cut else set()
        if fresh:
            self._learn(fresh)
        return [sum(map(self.pieces.__getitem__, x)) for x in cut]


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row, by the vocabulary file at ``path``.

    Whole texts, without added special tokens; special strings inside a text count one, as is the
    library's default. Null and empty texts have 0 bytes and 0 tokens. Repeated rows and null ids
    keep their rows; other columns of ``docs`` are not read; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(read_json(path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Counter(MergeTable(sent.value))
        for x in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in x.pop("text")]
            x["n_bytes"] = np.fromiter(map(len, texts), np.int64, len(texts))
            x["n_tokens"] = np.array(counter.count(texts), np.int64)
            x["over_limit"] = x["n_tokens"] > limit
            yield x

    zero = F.lit(0).cast("long")
    schema = docs.select("doc_id", zero.alias("n_bytes"), zero.alias("n_tokens"), F.lit(True).alias("over_limit")).schema
    return docs.select("doc_id", "text").mapInPandas(freeing(run), schema)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
