"""Joins of texts by keys and blocked vector joins against all pairs."""

import random
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from canvass.functions.udfs import Pack, alike_pairs, ratio_at_least
from canvass.operators.components import connected_components
from canvass.operators import joins, vectors


def words(rng, least, most):
    return " ".join(rng.choice(["a", "bb", "ab", "abc", "b", "ca"]) for _ in range(rng.randint(least, most)))


@pytest.mark.parametrize("limit", [0, 64 << 20])
def test_contained_phrases_are_those_of_all_pairs(spark, monkeypatch, limit):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", limit)
    rng = random.Random(4)
    texts = [(i, words(rng, 1, 40)) for i in range(120)] + [(500, ""), (501, "a")]
    phrases = [(i, words(rng, 1, 7)) for i in range(60)] + [(100, "a b c a"[1:]), (101, "b abc")]
    found = joins.containing(spark.createDataFrame(texts, "id int, t string"), spark.createDataFrame(phrases, "ord int, p string"), ["id"])
    want = {(i, o) for i, t in texts for o, p in phrases if p in t}
    got = [(r.id, r.ord) for r in found.collect()]
    assert set(got) == want and len(got) == len(want) and any(len(p.split()) > 4 for o, p in phrases if any(x == o for _, x in want))


@pytest.mark.parametrize("few", ["p", "t"])
def test_alike_texts_are_those_of_all_pairs(spark, few):
    rng = random.Random(5)
    a, b = [(i, words(rng, 1, 12)) for i in range(60)] + [(99, "")], [(i, words(rng, 1, 12)) for i in range(60)] + [(99, "")]
    found = joins.alike(spark.createDataFrame(a, "i int, p string"), spark.createDataFrame(b, "j int, t string"), "p", "t", 0.7, few)
    want = {(i, j): SequenceMatcher(None, x, y).ratio() for i, x in a for j, y in b}
    want = {k: r for k, r in want.items() if r >= 0.7}
    got = {(r.i, r.j): r.ratio for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want) and len(want) > 50


def test_control_plane_joins(spark):
    rows = spark.createDataFrame([("a", "x", None), ("b", "y", 1), ("c", "z", None)], "k string, kind string, n int")
    requests = spark.createDataFrame([("a", True), ("b", False), ("b", False)], "k string, active boolean")
    assert sorted(r.k for r in joins.without_active(rows, requests, "k", F.col("active")).collect()) == ["b", "c"]
    scoped = spark.createDataFrame([("s", "semantic"), ("s", "exact"), ("t", "exact"), (None, "exact")], "scope string, kind string")
    assert sorted(map(str, (tuple(r) for r in joins.scope_or_fallback(scoped, "scope", "kind", "semantic").select("scope", "kind").collect()))) == sorted(
        map(str, [("s", "semantic"), ("t", "exact"), (None, "exact")])
    )
    prior = spark.createDataFrame([("a", "old", 7), ("b", "old", 9)], "k string, kind string, n int")
    assert {r.k: r.n for r in joins.with_prior(rows, prior, "k", ("n",)).collect()} == {"a": 7, "b": 1, "c": None}
    watch = spark.createDataFrame([("x",), ("y",), ("y",)], "value string")
    assert sorted(r.k for r in joins.watched(rows, watch, F.col("kind") == F.col("value")).collect()) == ["a", "b"]


@pytest.mark.parametrize("blocks", [None, 1, 5])
def test_similar_pairs_are_those_of_all_pairs(spark, monkeypatch, blocks):
    monkeypatch.setattr(vectors, "FEW_ROWS", 20)
    monkeypatch.setattr(vectors, "SLICE", 7)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(150, 6))
    v[40:60] = v[:20] + 0.05 * rng.normal(size=(20, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(f"d{i % 2}", f"c{i}", x.tolist()) for i, x in enumerate(v)] + [("d0", "c0", v[0].tolist())], "docket_id string, comment_id string, v array<double>")
    found = [(r.a, r.b) for r in vectors.similar_pairs(rows, 0.9, blocks).collect()]
    want = {tuple(sorted((f"c{i}", f"c{j}"))) for i in range(150) for j in range(i) if i % 2 == j % 2 and v[i] @ v[j] >= 0.9}
    assert set(found) == want and all(a < b for a, b in found) and len(want) > 20


def test_links_and_nearest_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "FEW_ROWS", 20)
    monkeypatch.setattr(vectors, "SLICE", 7)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(150, 4))
    v[40:70] = v[:30] + 0.05 * rng.normal(size=(30, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([("d", f"c{i}" if i else None, x.tolist()) for i, x in enumerate(v)], "docket_id string, comment_id string, v array<double>")
    pairs = vectors.similar_pairs(rows, 0.95).localCheckpoint()
    links = vectors.similar_links(rows, 0.95).localCheckpoint()
    parts = lambda edges: {(r.node, r.component) for r in connected_components(edges).collect()}
    assert parts(links) == parts(pairs) and {(r.a, r.b) for r in links.collect()} <= {(r.a, r.b) for r in pairs.collect()}
    near = lambda found: {(r.comment_id, r.neighbour_id, r.rank) for r in found.collect()}
    assert near(vectors.nearest_similar(rows, 3, 0.95)) == near(vectors.nearest(pairs, 3, 0.95)) and pairs.count() > 80


def test_blocks_of_large_groups_give_back_little(spark):
    """Copies make a pair of every two: their links are a forest of each pair of blocks."""
    rows = spark.range(1200).selectExpr("'d' AS docket_id", "cast(id AS string) AS comment_id", "array(0.6D, 0.8D) AS v")
    assert vectors.similar_links(rows, 0.9).count() <= 6 * 1200
    assert vectors.nearest_similar(rows, 3, 0.9).count() == 3600


def test_cosine_rows_shuffle_nothing(spark):
    rows = spark.range(100).selectExpr("id", "array(1D, id + 1D) AS v")
    assert "Exchange" not in vectors.cosine_rows(rows.where("id % 50 = 0"), rows)._jdf.queryExecution().executedPlan().toString()


def test_cosine_rows_are_written_with_little_beside_the_cosine(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(rng.permutation(1 << 16)[:8000], rng.normal(size=(8000, 4)))], "id long, v array<double>").coalesce(1)
    vectors.cosine_rows(rows.limit(200), rows).write.parquet(f"{tmp_path}/out")
    (part,) = tmp_path.glob("out/*.parquet")
    groups = pq.ParquetFile(part).metadata
    size = {c: sum(groups.row_group(g).column(n).total_compressed_size for g in range(groups.num_row_groups)) for n, c in enumerate(("query_id", "id", "cosine"))}
    assert groups.num_rows == 200 * 7999 and size["query_id"] + size["id"] < groups.num_rows / 2


def test_cosine_rows_are_whole(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(70, 5))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    got = {(r.query_id, r.id): r.cosine for r in vectors.cosine_rows(rows.where("id % 10 = 0"), rows, block=3).collect()}
    assert len(got) == 7 * 69
    assert all(abs(c - v[q] @ v[i] / np.linalg.norm(v[q]) / np.linalg.norm(v[i])) < 1e-12 for (q, i), c in got.items())
    assert vectors.cosine_rows(rows.where("id < 0"), rows).count() == 0


def test_ratio_is_not_taken_of_what_only_shares_its_letters(monkeypatch):
    a, b = "abcdefghijklmnopqrstuvwxyz" * 3, "zyxwvutsrqponmlkjihgfedcba" * 3
    asked = []
    ratio = SequenceMatcher.ratio
    monkeypatch.setattr(SequenceMatcher, "ratio", lambda self: asked.append((self.a, self.b)) or ratio(self))
    got = ratio_at_least(0.6).func(pd.Series([a, a, None, "", "ab"]), pd.Series([b, a, a, "", "cd"]))
    assert got[1] == got[3] == 1.0 and got.notna().sum() == 2 and (a, b) not in asked


@pytest.mark.parametrize("threshold, few_first", [(0.6, False), (0.5, True), (0.85, False)])
def test_packed_texts_give_the_ratios_of_all_pairs(threshold, few_first):
    rng = random.Random(6)
    some = lambda n, most: ["".join(rng.choice("ab cé한") for _ in range(rng.randint(0, most))) for _ in range(n)]
    few = some(60, 40) + some(8, 700) + ["", "a" * 255, "a" * 256, "a" * 9000]
    many = some(60, 40) + [t[5:] + "ab" for t in few] + ["", "b" * 300, "a" * 256]
    want = {}
    for i, one in enumerate(many):
        for j, two in enumerate(few):
            ratio = SequenceMatcher(None, *((two, one) if few_first else (one, two))).ratio()
            if ratio >= threshold:
                want[i, j] = ratio
    found = list(alike_pairs(many, few, threshold, few_first))
    assert {(i, j): r for i, j, r in found} == want and len(found) == len(want) > 20


def test_packs_hold_common_subsequences_of_every_text():
    pack = Pack(["abcbdab", "", "x" * 300 + "y", "bdcaba"])
    assert pack.common([b"bdcaba", b"", b"x" * 299 + b"zy", b"abcbdab"]).tolist() == [[4, 0, 0, 6], [0, 0, 0, 0], [0, 0, 300, 0], [7, 0, 0, 4]]


@pytest.mark.parametrize("few, limit", [("p", 0), ("t", 0), ("p", 64 << 20), ("t", 64 << 20)])
def test_alike_keeps_repeated_and_drops_null_texts(spark, monkeypatch, few, limit):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", limit)
    a = spark.createDataFrame([(1, "one two three"), (2, "one two three"), (3, None), (4, "")], "i int, p string")
    b = spark.createDataFrame([(1, "one two three four"), (2, "one two three four"), (3, None), (4, ""), (5, "z" * 2000)], "j int, t string")
    got = sorted((r.i, r.j, round(r.ratio, 4)) for r in joins.alike(a, b, "p", "t", 0.6, few).collect())
    assert got == [(1, 1, 0.8387), (1, 2, 0.8387), (2, 1, 0.8387), (2, 2, 0.8387), (4, 4, 1.0)]
    assert joins.alike(a.where("i > 9"), b, "p", "t", 0.6, few).count() == joins.alike(a, b.where("j > 9"), "p", "t", 0.6, few).count() == 0


def test_alike_makes_no_rows_of_pairs_before_they_are_compared(spark):
    a = spark.createDataFrame([(i, f"number {i} of many") for i in range(50)], "i int, p string")
    b = spark.createDataFrame([(j, f"text {j} of few") for j in range(5)], "j int, t string")
    plan = joins.alike(a, b, "p", "t", 0.6, few="t")._jdf.queryExecution().optimizedPlan().toString()
    before = plan[plan.index("MapInArrow") :]
    assert plan.count("Join") == 1 and "Join" not in before


def test_words_are_split_once_and_not_again_in_each_loop(spark, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    texts = spark.createDataFrame([(1, "a text of some words")], "id int, t string")
    phrases = spark.createDataFrame([(1, "text of some wor")], "ord int, p string")
    found = joins.containing(texts.where("id > 0"), phrases.where("ord > 0"), ["id"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(split(" not in plan and "get(split(" not in plan and "size(split(" not in plan and found.count() == 1
