"""SimHash, winnowing, language ID, mixing and nearest neighbours against brute force."""

import hashlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from canvass.llm import ann, langid, mixing, simhash, winnow


def plain_simhash(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    k = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def plain_components(fps, ids, bits=2):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= bits:
                parent[find(b)] = find(a)
    groups = defaultdict(list)
    for f, i in ids:
        groups[find(f)].append(i)
    return {f: min((i for i in groups[find(f)] if i is not None), default=None) for f in fps}


def test_simhash_components(docs, texts):
    pairs = [(plain_simhash(t), i) for i, t in texts]
    want = plain_components({f for f, _ in pairs}, pairs)
    got = [(r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(map(str, got)) == sorted(str((i, f, want[f])) for f, i in pairs)


@pytest.mark.parametrize("paired", [0, 3, 10**6])
def test_links_connect_all_that_are_near(spark, paired, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRED", paired)
    rng = np.random.default_rng(5)
    fps = {int(x) for x in rng.integers(0, 2**63, 40)}
    for f in list(fps)[:12]:
        for _ in range(12):
            near = f
            for j in rng.choice(64, rng.integers(0, 5), replace=False):
                near ^= 1 << int(j)
            fps.add(near)
    table = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in fps], "fp long")
    found = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(table).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in found)
    near = {(min(a, b), max(a, b)) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 2}
    assert near and _parts(fps, found) == _parts(fps, near)


def _parts(nodes, edges):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    groups = defaultdict(set)
    for x in nodes:
        groups[find(x)].add(x)
    return sorted(map(sorted, groups.values()))


def test_one_of_each_group_stays(docs, texts):
    found = simhash.near_duplicates(docs).select("doc_id", "component_id", "fp").collect()
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    named = {r.component_id for r in found if r.component_id is not None}
    assert sorted(i for i in ids if i is not None) == sorted(named)
    alone = {r.fp % 2**64 for r in found if r.component_id is None}
    assert ids.count(None) == len(set(plain_components(alone, [(f, f) for f in alone]).values()))


def test_rows_that_share_an_id_are_judged_by_their_text(spark):
    other = spark.createDataFrame([(1, "one text of some words here"), (1, "quite another one that is alone"), (2, "one text of some words here"), (None, "a third")], "doc_id long, text string")
    assert sorted(r.text for r in simhash.deduplicate(other).collect()) == ["a third", "one text of some words here", "quite another one that is alone"]


def plain_winnow(text):
    words = (text or "").lower().strip(" \t\n\x0b\x0c\r")
    words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    h = [((x - 2**64) if x >> 63 else x) % winnow.PRIME for x in h]
    k = min(winnow.K, len(h))
    grams = []
    for i in range(len(h) - k + 1 if h else 0):
        g = 0
        for x in h[i : i + k]:
            g = (g * winnow.BASE + x) % winnow.PRIME
        grams.append(g)
    chosen = []
    for i in range(max(len(grams) - winnow.W + 1, min(len(grams), 1))):
        window = grams[i : i + winnow.W]
        low = min(window)
        at = i + max(j for j, g in enumerate(window) if g == low)
        if (low, at) not in chosen[-1:]:
            chosen.append((low, at))
    return chosen


def likeness(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def test_winnowing(docs, texts):
    got = sorted((str(r.doc_id), [(x.hash, x.position) for x in r.fingerprint]) for r in winnow.fingerprints(docs).collect())
    assert got == sorted((str(i), plain_winnow(t)) for i, t in texts)


@pytest.mark.parametrize("rows", [1, 2, 10, 10**6])
def test_edited_texts(docs, texts, rows, monkeypatch):
    monkeypatch.setattr(winnow, "RANGE_ROWS", rows)
    signed = lambda x: x - 2**64 if x >> 63 else x
    place = lambda i, t: (i is None, -(signed(xxhash.xxh64_intdigest(t, 42)) if i is None else i), t)  # noqa: E731; null ids come by hash
    order = sorted(((i, t or "") for i, t in texts), key=lambda x: place(*x))
    want = []
    for at, (i, t) in enumerate(order):
        after, third = order[(at + 1) % len(order)][1], len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        own = plain_winnow(t)
        want.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), round(likeness(own, plain_winnow(edited)), 9), round(likeness(own, plain_winnow(after)), 9)))
    got = [
        (str(r.doc_id), r.n_chars, hashlib.sha256(r.edited.encode()).hexdigest(), round(r.near_edited, 9), round(r.near_next, 9))
        for r in winnow.compare_edited(docs).collect()
    ]
    assert sorted(got) == sorted(want)


def test_shared_passages_share_a_fingerprint():
    words = [f"w{i}" for i in range(100)]
    passage = words[40 : 40 + winnow.K + winnow.W - 1]
    a, b = plain_winnow(" ".join(words)), plain_winnow(" ".join(["x", "y", *passage, "z"]))
    assert {h for h, _ in a} & {h for h, _ in b}


def test_single_document_is_its_own_next(spark):
    row = winnow.compare_edited(spark.createDataFrame([(7, "a b c d e f")], "doc_id long, text string")).first()
    text = "a b c d e f"
    assert row.edited == text[:8] + text[:3]
    assert row.near_next == 1.0


def test_no_documents(nothing):
    assert simhash.near_duplicates(nothing).count() == 0
    assert winnow.compare_edited(nothing).count() == 0
    assert mixing.mix(nothing).count() == 0
    assert mixing.mixed(nothing).count() == 0
    assert langid.accepted(nothing).count() == 0
    assert simhash.deduplicate(nothing).count() == 0


def test_languages(docs, texts):
    models = langid.learned(docs)
    assert models.langs == ["de", "en", "fr"]
    rows = langid.identify(docs, models).join(docs.select("doc_id", "lang"), "doc_id").collect()
    clean = [r for r in rows if r.doc_id < 60]
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 and not r.rejected for r in clean)
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert und == {100, 101, 102, 103}
    assert all(r.rejected for r in rows if r.doc_id in und)
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= set(range(60)) and not {r.doc_id for r in kept.collect()} & und


def plain_kneser_ney(counts, order, alphabet):
    """The probability of a symbol after a context, by the textbook's recursion over dictionaries."""
    grams = [Counter() for _ in range(order + 1)]
    for word, n in counts.items():
        marked = f"\x01{word}\x02"
        for i in range(1, len(marked)):
            for k in range(1, order + 1):
                if i - k + 1 >= 0:
                    grams[k][marked[i - k + 1 : i + 1]] += n
    amount = [Counter() for _ in range(order + 1)]
    amount[order] = grams[order]
    for k in range(order - 1, 0, -1):
        for g in grams[k]:
            left = sum(1 for h in grams[k + 1] if h[1:] == g)
            amount[k][g] = max(grams[k][g] if k > 1 and g[0] == "\x01" else left, 1)
    discount = [0.0] * (order + 1)
    for k in range(1, order + 1):
        ones, twos = (sum(1 for x in amount[k].values() if x == n) for n in (1, 2))
        discount[k] = min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.95)

    def prob(context, symbol):
        k = len(context) + 1
        below = prob(context[1:], symbol) if context else 1 / alphabet
        after = [x for g, x in amount[k].items() if g[:-1] == context]
        if not after:
            return below
        own = amount[k].get(context + symbol, 0)
        return (max(own - discount[k], 0) + discount[k] * len(after) * below) / sum(after)

    return prob


def test_models_equal_the_recursion():
    counts = [Counter({"abab": 3, "abc": 2, "b": 1, "cab": 2, "aa": 1}), Counter({"ca": 2, "acca": 1})]
    models = langid.LanguageModels(["x", "y"], counts)
    words = ["abab", "abca", "cc", "zab", "a", "cab"]
    got = {w: row for some, rows in models.word_scores(words) for w, row in zip(some, rows)}
    for i, own in enumerate(counts):
        prob = plain_kneser_ney(own, langid.ORDER, models.alphabet)
        for w in words:
            marked = f"\x01{w}\x02"
            want = sum(np.log(prob(marked[max(0, j - langid.ORDER + 1) : j], marked[j])) for j in range(1, len(marked)))
            assert abs(got[w][i] - want) < 1e-4, (w, i)
        for context in ("\x01", "\x01a", "ab", "c", "zz"):
            known = [prob(context, s) for s in "abc\x02"]
            assert abs(sum(known) + (models.alphabet - 4) * prob(context, "?") - 1) < 1e-9


def test_memory_depends_neither_on_languages_nor_on_texts(monkeypatch):
    import tracemalloc

    langs = [f"l{i:02d}" for i in range(64)]
    models = langid.LanguageModels(langs, [Counter({f"w{chr(97 + i % 26)}{chr(97 + i // 26)}{c}": 3 for c in "abcdefgh"}) for i in range(64)])
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(letters[(i * 7 + i // (3**j)) % 26] for j in range(8)) + letters[i % 26] for i in range(120_000)]
    scorer = langid.Scorer(models)
    tracemalloc.start()
    scorer.sums([" ".join(words), None, "", "x" * 300_000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20 and len(scorer.index) <= 2 * scorer.room


def test_windows_and_bounds_change_no_sum(monkeypatch, texts):
    models = langid.LanguageModels(["a", "b"], [Counter({"the": 3, "cat": 2}), Counter({"le": 3, "chat": 2})])
    some = [t for _, t in texts] + ["a\u2003b c" * 100, " x ", "\n\n"]
    want = langid.Scorer(models).sums(some)
    monkeypatch.setattr(langid, "WINDOW", 7)
    monkeypatch.setattr(langid.windows, "__defaults__", (7,))
    monkeypatch.setattr(langid, "REMEMBERED", 5)
    monkeypatch.setattr(langid, "CELLS", 3)
    got = langid.Scorer(models).sums([t if len(t or "") < 9000 else t[:9000] for t in some])
    short = [i for i, t in enumerate(some) if len(t or "") < 9000]
    for a, b in zip(got, want):
        assert np.allclose(a[short], b[short])


def test_each_n_gram_of_a_block_is_looked_up_once(monkeypatch):
    rng = np.random.default_rng(2)
    words = list({"".join(rng.choice(list("abcd"), rng.integers(1, 12))) for _ in range(3000)})
    models = langid.LanguageModels(["x", "y"], [Counter(dict.fromkeys(words[:50], 2)), Counter(dict.fromkeys(words[40:90], 3))])
    alone = np.concatenate([rows for w in words for _, rows in models.word_scores([w])])
    wanted, of = [], langid._Sparse.of
    monkeypatch.setattr(langid._Sparse, "of", lambda self, x: wanted.append(len(x)) or of(self, x))
    together = np.concatenate([rows for _, rows in models.word_scores(words)])
    assert (together == alone).all()
    assert max(wanted) <= sum(5**n for n in range(1, 5))


def test_sums_are_those_of_the_words(texts):
    models = langid.LanguageModels(["a", "b"], [Counter({"the": 3, "cat": 2}), Counter({"le": 3, "chat": 2})])
    odd = ["ΑΣ ΣΑΣ. ΑΣ\u0301Α", "İstanbul'da \x00 x\x01y 12 3a4 a-b-a-b", "\ud800x é\u0301 ﬁ ǅ", "the\x1cthe\u2028The-the\x85cat", "1 2", ""]
    some = [t or "" for _, t in texts if len(t or "") < 9000] + odd
    sums, events, letters = langid.Scorer(models).sums(some)
    for text, row, n, m in zip(some, sums, events, letters):
        words = [w for p in text.split() for w in langid.words_of(p)]
        want = sum((rows[0] for w in words for _, rows in models.word_scores([w])), np.zeros(2))
        assert np.allclose(row, want) and (n, m) == (sum(len(w) + 1 for w in words), sum(map(len, words)))


def test_a_language_of_few_documents_rejects_random_letters(spark):
    rows = [(i, "some words of one language are here " * 3 + "word " * (i % 5), "en") for i in range(12)]
    docs = spark.createDataFrame(rows + [(50, "qzx jkwvq xqzjk vwxqz", None), (51, None, None)], "doc_id long, text string, lang string")
    models = langid.fit(docs)
    assert np.isfinite(models.usual).all()
    assert {r.doc_id for r in langid.identify(docs, models).where("rejected").collect()} == {50, 51}


def test_unlabelled_documents_teach_nothing(docs):
    models = langid.fit(docs.where("lang is null"))
    assert {(r.lang_pred, r.rejected) for r in langid.identify(docs, models).collect()} == {("und", True)}


def test_mixing_by_running_sums(docs, spark):
    got = {(r.doc_id, r.size, r.source_size, round(r.target, 6), r.size * r.copies) for r in mixing.mix(docs).collect()}
    documents = docs.select("doc_id", "text", "source").toPandas()
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    want = duckdb.sql(mixing.OP9_SQL).fetchall()
    assert got == {(i, n, m, round(t, 6), k) for i, n, m, t, k in want}


@pytest.mark.parametrize("small", [0, 10**6])
def test_budgets_are_met_and_shared_by_weight(spark, small, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", small)
    rows = [(i, "w " * (1 + i % 5), None if i % 10 == 0 else f"s{i % 3}") for i in range(600)] + [(1000 + i, "one two", "tiny") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs).collect()
    total = sum(r["size"] for r in found)
    per = {r.source: (r.source_size, r.target) for r in found}
    assert abs(sum(t for _, t in per.values()) - total) < 1e-6 and all(t <= 3 * n + 1e-9 for n, t in per.values())
    free = {s: t for s, (n, t) in per.items() if t < 3 * n - 1e-9}
    weight = {"s0": 1, "s1": 2, "s2": 3, "tiny": 1, None: 2}
    assert len({round(t / weight[s], 6) for s, t in free.items()}) == 1
    for s, (_, target) in per.items():
        taken = sum(r["size"] * r.copies for r in found if r.source == s)
        assert abs(taken - target) <= 5 and all(0 <= r.copies <= 3 for r in found)
    assert sorted(r.doc_id for r in mixing.mixed(docs).collect()) == sorted(r.doc_id for r in found for _ in range(r.copies))


def brute_neighbours(rows, k=5):
    fine = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v) and len(v) == 8]
    out = set()
    for q, v in fine:
        if q % 50 == 0:
            cos = sorted((-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 9), i) for i, w in fine if i != q)
            out |= {(q, r + 1, i) for r, (_, i) in enumerate(cos[:k])}
    return out


def test_nearest_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 64)
    monkeypatch.setattr(ann, "QUERIES", 3)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).astype("float32").tolist()) for i in range(400)]
    same = rows[0][1]
    rows += [(i, same) for i in range(1000, 1030)]  # ties
    rows += [(500, None), (501, [0.0] * 8), (502, [float("nan")] * 8), (503, [None] * 8), (504, [1.0] * 3), (550, [float("inf")] * 8), (1050, [1e30] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    found = ann.search(table, F.col("vec_id") % 50 == 0).collect()
    got, want = {(r.query_id, r["rank"], r.vec_id) for r in found}, brute_neighbours(rows)
    assert {q for q, _, _ in got} == {q for q, _, _ in want} and len(got) == len(want)
    assert len(got & want) >= 0.95 * len(want)
    assert {x for x in got if x[0] in (0, 1000)} == {x for x in want if x[0] in (0, 1000)}
    assert ann.search(table.where("vec_id = 501"), F.col("vec_id") % 50 == 0).count() == 0
    assert ann.search(table.where("vec_id in (0, 1)"), F.col("vec_id") % 50 == 0).count() == 1


def test_quantised_scans_choose_what_is_ranked_exactly(spark, monkeypatch):
    """Blocks of 1,500 vectors of which 25 are ranked exactly: without good scans recall would be 0.02."""
    monkeypatch.setattr(ann, "BLOCK", 1500)
    monkeypatch.setattr(ann, "RERANK", 5)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 32))
    v = centres[rng.integers(0, 40, 3000)] + 0.5 * rng.normal(size=(3000, 32))
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(2)
    got = {(r.query_id, r.vec_id) for r in ann.search(table, F.col("vec_id") % 50 == 0).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    cos = unit[::50] @ unit.T
    cos[np.arange(60), np.arange(0, 3000, 50)] = -2
    want = {(50 * q, int(i)) for q, row in enumerate(cos) for i in np.argsort(-row)[:5]}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_repeated_and_null_ids_lengths_and_names(spark):
    rows = [(0, [1.0, 0.0], 1.0, 2)] * 3 + [(1, [1.0, 0.1], 1.0, 2)] * 9 + [(2, [0.0, 1.0], 1.0, 2), (None, [1.0, 0.0], 1.0, 2), (3, [1.0, 1.0, 0.0], 1.0, 3), (50, [1.0, 0.0, 0.0], 1.0, 3), (100, [1.0, 0.2], 1.0, 2)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double, rank int")
    found = [(r.query_id, r["rank"], r.vec_id) for r in ann.search(table, F.col("vec_id") % 50 == 0).collect()]
    assert sorted(found) == [(0, 1, 1), (0, 2, 100), (0, 3, 2), (50, 1, 3), (100, 1, 1), (100, 2, 0), (100, 3, 2)]
