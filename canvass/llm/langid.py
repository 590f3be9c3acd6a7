"""Language ID (operator 2): interpolated Kneser-Ney character models in sorted hash arrays.

A model reads the words of a text (runs of letters, in lower case), each between a start and an
end mark. The n-grams of all languages lie in one sorted array of 64-bit hashes for each
order, beside the languages that have the n-gram with their interpolated log-probabilities, or
for contexts the weight left to the next lower order. The text's language is the one with the
lowest cross-entropy per character.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.llm.common import freeing, sent_model, small_batches, table

ORDER = 4
#: Bound of the labelled sample the models are fitted on: documents of each language, and of all together.
DOCS_PER_LANG = 400
SAMPLE_DOCS = 100_000
#: One in so many of the sample's documents calibrates the scores instead.
CALIBRATION = 5
#: A document is rejected where its cross-entropy lies this many standard deviations above what is
#: usual for its language, and nearer to that of letters drawn at random.
REJECT_SD = 8.0
#: A language with fewer calibration texts than this takes what is usual for all languages together.
FEW = 8
UNKNOWN = "und"
#: Bounds of a task's memory, whatever the texts: characters cut into pieces at once, pieces remembered
#: (and bytes of their scores) before it forgets them all, and cells (characters x languages) scored at once.
WINDOW, REMEMBERED, REMEMBERED_BYTES, CELLS = 1 << 18, 200_000, 16 << 20, 1 << 19
_START, _END = 1, 2
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_WORDS = regex.compile(r"\p{L}+").findall
_WORDS_AND_BREAKS = regex.compile(r"\p{L}+|\n").findall
_GAP = re.compile(r"\s")


def words_of(text: str) -> list[str]:
    return _WORDS(text.lower())


def windows(text: str, size: int = WINDOW) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut only where a piece between white space ends."""
    at = 0
    while len(text) - at > size:
        end = _GAP.search(text, at + size)
        if not end:
            break
        yield text[at : end.start()]
        at = end.start()
    yield text[at:] if at else text


def _events(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words with their marks, each one's place in its word, and the words' starts."""
    text = "".join(f"\x01{w}\x02" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    return codes, np.arange(len(codes)) - np.repeat(starts, sizes), starts


def _hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """Hash of the n symbols that end at each place, for n from 0 to ``order``."""
    own, out = (codes + np.uint64(1)) * _MIX, [np.zeros(len(codes), np.uint64)]
    for _ in range(order):
        before = np.append(np.zeros(1, np.uint64), out[-1][:-1])
        out.append(before * _BASE + (own ^ (own >> np.uint64(29))))
    return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def kneser_ney(counts: Counter, order: int, alphabet: int) -> list[dict[str, np.ndarray]]:
    """For each order, n-gram hashes with probabilities, and context hashes with the weight of the lower order."""
    words = list(counts)
    codes, place, _ = _events(words)
    weight = np.repeat(np.fromiter(counts.values(), np.int64, len(words)), np.fromiter(map(len, words), np.int64, len(words)) + 2)
    hashes, types = _hashes(codes, order), []
    for n in range(1, order + 1):
        at = np.flatnonzero((place >= 1) & (place >= n - 1))
        keys, first, inverse = np.unique(hashes[n][at], return_index=True, return_inverse=True)
        i = at[first]
        context = hashes[n - 1][i - 1] if n > 1 else np.zeros(len(i), np.uint64)
        types.append({"keys": keys, "raw": np.bincount(inverse, weight[at], len(keys)), "opens": place[i] == n - 1,
                      "context": context, "suffix": hashes[n - 1][i]})
    out, lower = [], None
    for n, t in enumerate(types, 1):
        amount = t["raw"]
        if n < order:  # distinct symbols to the left, but for n-grams that open a word
            left = types[n]["suffix"]
            at, known = _find(t["keys"], left)
            amount = np.where(t["opens"] & (n > 1), amount, np.bincount(at[known], minlength=len(t["keys"])))
            amount = np.maximum(amount, 1)
        ones, twos = (amount == 1).sum(), (amount == 2).sum()
        discount = min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.95)
        contexts, inverse = np.unique(t["context"], return_inverse=True)
        total = np.bincount(inverse, amount)
        rest = discount * np.bincount(inverse) / total
        below = 1 / alphabet if lower is None else lower["prob"][_find(lower["keys"], t["suffix"])[0]]
        prob = (amount - discount) / total[inverse] + rest[inverse] * below
        lower = {"keys": t["keys"], "prob": prob, "contexts": contexts, "rest": rest}
        out.append(lower)
    return out


class _Sparse:
    """Values of several languages by hash: sorted keys, and for each the languages that have it."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]]):
        none = np.zeros(0, np.uint64)
        keys = np.concatenate([none, *[k for k, _ in parts]])
        lang = np.repeat(np.arange(len(parts), dtype=np.int32), [len(k) for k, _ in parts])
        order = np.argsort(keys, kind="stable")
        self.lang, self.value = lang[order], np.concatenate([none.astype(np.float32), *[v for _, v in parts]]).astype(np.float32)[order]
        self.keys, first = np.unique(keys[order], return_index=True)
        self.first = np.append(first, len(keys)).astype(np.int64)

    def of(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each value found, the place in ``wanted``, the language and the value."""
        at, known = _find(self.keys, wanted)
        place = np.flatnonzero(known)
        begin, n = self.first[at[place]], np.diff(self.first)[at[place]] if len(self.keys) else np.zeros(0, np.int64)
        ends = np.cumsum(n)
        of = np.repeat(begin - ends + n, n) + np.arange(ends[-1] if len(n) else 0)
        return np.repeat(place, n), self.lang[of], self.value[of]


class LanguageModels:
    """Character models of several languages, with calibrated scores and rejection."""

    def __init__(self, langs: list[str], counts: list[Counter], order: int = ORDER):
        self.langs, self.order = langs, order
        self.alphabet = max(256, len({c for x in counts for w in x for c in w}) + 2)
        models = [kneser_ney(x, order, self.alphabet) for x in counts]
        self.grams, self.backoff = [], []
        for n in range(order):
            self.grams.append(_Sparse([(m[n]["keys"], np.log(m[n]["prob"])) for m in models]))
            self.backoff.append(_Sparse([(m[n]["contexts"], np.log(m[n]["rest"])) for m in models]))
        # Where nothing is known of a language, only what is near to letters drawn at random is rejected.
        self.sharpness, self.usual = 1.0, np.tile([0.7 * np.log(self.alphabet), 0.0, 0.0], (len(langs), 1))

    def word_scores(self, words: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
        """Log-probability of each word and its end in each language, some words at a time."""
        most, first, size = max(1, CELLS // max(len(self.langs), 1)), 0, 0
        for i, w in enumerate(words):
            size += len(w) + 2
            if size >= most or i == len(words) - 1:
                yield words[first : i + 1], self._scores(words[first : i + 1])
                first, size = i + 1, 0

    def _scores(self, words: list[str]) -> np.ndarray:
        codes, place, starts = _events(words)
        hashes, out = _hashes(codes, self.order), np.zeros((len(words), len(self.langs)))
        most = max(1, CELLS // max(len(self.langs), 1))
        for low in range(0, len(codes), most):  # one slice, but for words longer than that
            high = min(low + most, len(codes))
            which, at = self._distinct(hashes, place, low, high)
            score = np.full((len(at), len(self.langs)), -np.log(self.alphabet))
            for n in range(1, self.order + 1):
                row = np.flatnonzero((place[at] >= 1) & (place[at] >= n - 1))
                context = hashes[n - 1][at[row] - 1] if n > 1 else np.zeros(len(row), np.uint64)
                i, lang, value = self.backoff[n - 1].of(context)
                score[row[i], lang] += value
                i, lang, value = self.grams[n - 1].of(hashes[n][at[row]])
                score[row[i], lang] = value
            score[place[at] == 0] = 0.0
            first = np.searchsorted(starts, low, "right") - 1
            own = starts[first:][starts[first:] < low + most]
            out[first : first + len(own)] += np.add.reduceat(score[which], np.maximum(own - low, 0), axis=0)
        return out

    def _distinct(self, hashes: list[np.ndarray], place: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams that end at the places from ``low`` to ``high``, as numbers, and one place of each.

        A symbol's score depends only on the symbols of its word before it, ``order`` of them with itself, and few of these differ.
        """
        key = hashes[self.order][low:high]
        for n in range(1, self.order):
            key = np.where(place[low:high] == n - 1, hashes[n][low:high], key)
        which, keys = pd.factorize(key)
        at = np.zeros(len(keys), np.int64)
        at[which] = np.arange(low, high)
        return which, at

    def judge(self, sums: np.ndarray, events: np.ndarray, letters: np.ndarray) -> pd.DataFrame:
        """Language, score, cross-entropy (nats for each character) and rejection of texts from their sums."""
        n = len(events)
        if not self.langs:
            return pd.DataFrame({"lang_pred": [UNKNOWN] * n, "score": 0.0, "cross_entropy": np.nan, "rejected": True})
        size = np.maximum(events, 1)
        entropy = -sums / size[:, None]
        best = np.argmin(entropy, axis=1)
        least = entropy[np.arange(n), best]
        odds = np.exp(-(entropy - least[:, None]) * self.sharpness * np.sqrt(size)[:, None])
        mean, fixed, by_size = self.usual[best].T
        none = letters == 0
        out = pd.DataFrame({"lang_pred": np.array(self.langs, object)[best], "score": 1 / odds.sum(axis=1), "cross_entropy": least})
        limit = np.maximum(mean + REJECT_SD * np.sqrt(fixed + by_size / size), (mean + np.log(self.alphabet)) / 2)
        out["rejected"] = none | (least > limit)
        out.loc[none, ["lang_pred", "score", "cross_entropy"]] = [UNKNOWN, 0.0, np.nan]
        return out

    def calibrate(self, texts: list[str], langs: list[str]) -> None:
        """Sharpness of the scores by likelihood; usual cross-entropy of each language and its spread."""
        sums, events, letters = Scorer(self).sums(texts)
        truth = np.array([self.langs.index(x) for x in langs])
        ok = letters > 0
        sums, events, truth = sums[ok], events[ok], truth[ok]
        if not len(truth):
            return
        entropy = -sums / events[:, None]
        own = entropy[np.arange(len(truth)), truth]
        gap = (entropy - own[:, None]) * np.sqrt(events)[:, None]
        grid = np.geomspace(0.01, 10, 40)
        loss = [np.logaddexp.reduce(-gap * s, axis=1).mean() for s in grid]
        self.sharpness = float(grid[int(np.argmin(loss))])
        usual = lambda x, size: (  # noqa: E731; the variance by size comes from a median of squares
            mean := np.average(x, weights=np.sqrt(size)), float(np.var(x)), float(np.median((x - mean) ** 2 * size)) * 2.2
        )
        if len(own) >= FEW:
            self.usual[:] = usual(own, events)
        for i in range(len(self.langs)):
            if (truth == i).sum() >= FEW:
                self.usual[i] = usual(own[truth == i], events[truth == i])


class Scorer:
    """Sums of word scores over texts; remembers the pieces between white space that it has seen.

    A text is taken in windows, and what is remembered or scored at once is bounded in bytes, so memory
    depends neither on the texts nor on the number of languages.
    """

    def __init__(self, models: LanguageModels):
        self.models, self.index, self.width = models, {}, len(models.langs) + 2
        self.room = max(1, min(REMEMBERED, REMEMBERED_BYTES // (8 * self.width)))
        self.rows = np.zeros((0, self.width))

    def _learn(self, fresh: list[str]) -> None:
        used = len(self.index)
        if used + len(fresh) > len(self.rows):
            self.rows = np.concatenate([self.rows[:used], np.zeros((max(len(fresh), min(used, self.room)), self.width))])
        # A piece holds no white space, so each begins with the only line break before it.
        found = np.array(_WORDS_AND_BREAKS("\n" + "\n".join(fresh).lower()), object)
        which, words = pd.factorize(found)
        owner, order = np.cumsum(which == 0) - 1, np.argsort(which, kind="stable")
        which, owner, words = which[order] - 1, owner[order], words[1:].tolist()
        done = 0
        for some, scores in self.models.word_scores(words):
            low, high = np.searchsorted(which, (done, done + len(some)))
            each, flat = which[low:high] - done, owner[low:high]
            size = np.fromiter(map(len, some), np.int64, len(some))
            for column, values in enumerate([*scores.T, size + 1, size]):
                self.rows[used : used + len(fresh), column] += np.bincount(flat, values[each], len(fresh))
            done += len(some)
        self.index.update(zip(fresh, range(used, used + len(fresh))))

    def _add(self, cut: list[tuple[int, list[str]]], out: np.ndarray) -> None:
        """Add the pieces of each text to its row; together they are ``room`` at most."""
        if len(self.index) >= self.room:
            self.index, self.rows = {}, np.zeros((0, self.width))
        if fresh := list(set().union(*(x for _, x in cut)) - self.index.keys()):
            self._learn(fresh)
        if cut := [(i, x) for i, x in cut if x]:
            size = np.fromiter((len(x) for _, x in cut), np.int64, len(cut))
            at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(x for _, x in cut)), np.int64, size.sum())
            np.add.at(out, [i for i, _ in cut], np.add.reduceat(self.rows[at], np.cumsum(size) - size, axis=0))

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text the log-probability by language, the characters with word ends, and the letters."""
        out, cut, size = np.zeros((len(texts), self.width)), [], 0
        for i, text in enumerate(texts):
            for part in windows(text or ""):
                pieces = part.split()
                for at in range(0, len(pieces), self.room):
                    some = pieces[at : at + self.room]
                    if size + len(some) > self.room:
                        self._add(cut, out)
                        cut, size = [], 0
                    cut.append((i, some))
                    size += len(some)
        self._add(cut, out)
        return out[:, :-2], out[:, -2], out[:, -1]


def held_out(doc_id: str = "doc_id") -> Column:
    """Every fifth document by checksum of its id is never learned from; a null id counts as false."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(labelled: DataFrame, docs_per_lang: int = DOCS_PER_LANG, order: int = ORDER) -> LanguageModels:
    """Models of the languages in ``labelled`` (columns ``text``, ``lang``), from a bounded sample.

    The sample has about ``docs_per_lang`` distinct whole documents of each language (fewer if that would
    make more than ``SAMPLE_DOCS``), chosen by a hash of the text; only the sample comes to the driver. Every
    language is learned; more of them than ``SAMPLE_DOCS`` raise an error. Rows with a null text
    or language teach nothing; without any rows there are no languages.
    """
    labelled = labelled.select("lang", "text").where("lang is not null and text is not null")
    counts = labelled.groupBy("lang").agg(F.approx_count_distinct("text").alias("n")).limit(SAMPLE_DOCS + 1).collect()
    if not counts:
        return LanguageModels([], [], 0)
    if len(counts) > SAMPLE_DOCS:
        raise ValueError(f"over {SAMPLE_DOCS} languages")
    docs_per_lang = max(1, min(docs_per_lang, SAMPLE_DOCS // len(counts)))
    scale = 1 << 30
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(scale, scale * docs_per_lang // max(r["n"], 1) + 1))])
    rank = F.pmod(F.xxhash64("text"), F.lit(scale))
    rows = labelled.where(rank < F.element_at(share, F.col("lang"))).distinct().collect()
    rows = sorted((r["lang"], r["text"]) for r in rows)
    words: dict[str, Counter] = {}
    kept = [(lang, text) for i, (lang, text) in enumerate(rows) if i % CALIBRATION]
    for lang, text in kept:
        words.setdefault(lang, Counter()).update(words_of(text))
    langs = sorted(x for x in words if words[x])
    models = LanguageModels(langs, [words[x] for x in langs], order) if langs else LanguageModels([], [], 0)
    test = [r for i, r in enumerate(rows) if not i % CALIBRATION and r[0] in langs]
    if test:
        models.calibrate([t for _, t in test], [x for x, _ in test])
    return models


def predictor(spark: SparkSession, models: LanguageModels):
    """A column function from text to ``lang_pred, score, cross_entropy, rejected``."""
    small_batches(spark)
    sent = sent_model(spark, models)  # bounded by the sample that it was fitted on

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(sent())
        for texts in batches:
            yield scorer.models.judge(*scorer.sums(texts.tolist()))

    @F.pandas_udf("lang_pred string, score double, cross_entropy double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from freeing(run)(batches)

    return predict


def identify(docs: DataFrame, models: LanguageModels) -> DataFrame:
    """``doc_id, lang_pred, score, cross_entropy, rejected`` of every row, from the whole text alone.

    Null texts and those without a letter get ``und``, score 0 and are rejected. Other texts get the
    learned language of lowest cross-entropy, and are rejected only where that lies far above
    what the language's own documents of their length have, nearer to letters drawn at random. Ties go to the first language by name.
    Repeated rows and null ids keep their rows; other columns of ``docs`` are not read.
    """
    found = predictor(docs.sparkSession, models)(F.col("text"))
    return docs.select("doc_id", found.alias("found")).select("doc_id", "found.*")


def learned(docs: DataFrame) -> LanguageModels:
    return fit(docs.where(~held_out()))


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is recognised, with models fitted on its own labels."""
    return docs.where(~predictor(docs.sparkSession, learned(docs))(F.col("text")).getField("rejected"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learned(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
