"""Operators on small fixtures."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from canvass.functions import scores
from canvass.functions import text as X
from canvass.functions.udfs import clean_html, html_text, mock_embedding, ratio, ratio_bound
from canvass.operators import clusters as C
from canvass.operators import evidence as V
from canvass.operators import export as E
from canvass.operators import vectors as N
from canvass.operators.components import connected_components


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, x) for x in range(201, 260)] + [(300 + i, 300 + (i + 1) % 7) for i in range(7)] + [(400, 400), (500, 501), (501, 500), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(101)} == {0} and {got[i] for i in range(200, 260)} == {200} and {got[i] for i in range(300, 307)} == {300}
    assert got[400] == 400 and got[500] == got[501] == 500 and None not in got
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_normalize_takes_unicode_white_space(spark):
    text = "  This is the \x1c actual\n comment.　"
    assert one(spark, X.normalize(F.col("t")), t=text) == "this is the actual comment."
    assert one(spark, X.text_hash(X.normalize(F.col("t"))), t="Hello  World") == hashlib.sha256(b"hello world").hexdigest()


@pytest.mark.parametrize("text,want", [(" alpha\n  beta\tgamma ", "alpha beta gamma"), ("x" * 550, "x" * 497 + "..."), ("", None), ("  ", None)])
def test_truncate(spark, text, want):
    assert one(spark, X.truncate(F.col("t")), t=text) == want


@pytest.mark.parametrize("n,want", [(0, 0), (3, 1), (400, 100)])
def test_token_estimate(spark, n, want):
    assert one(spark, X.token_estimate(F.col("t")), t="x" * n if n else None) == want


def test_cover_notes(spark):
    note = lambda has: one(spark, X.is_cover_note(F.col("t"), F.lit(has)), t="See attached pdf")
    assert note(True) and not note(False)


def test_sections(spark):
    text = "# comment\nintro\n## One\nbody one\n#\n## Two\n\n## Three\nbody three\nmore"
    got = one(spark, X.sections(F.col("t")), t=text)
    assert [(s.name, s.body) for s in got] == [("__preamble__", "intro"), ("One", "body one"), ("Three", "body three\nmore")]
    assert [(s.name, s.body) for s in one(spark, X.sections(F.col("t")), t="plain")] == [("__preamble__", "plain")]


def test_topic_and_tags(spark):
    assert one(spark, X.topic(F.col("t"), F.lit("other")), t="Methane and broadband") == "oil_and_gas"
    assert one(spark, X.topic_tags(F.col("t"), F.lit("ai, x"), F.lit("FTC")), t="Software rule") == "ai, x, Software, Transparency, FTC"


@pytest.mark.parametrize("args,want", [((10, 9, 1), "paraphrase"), ((10, 2, 7), "exact_duplicate"), ((10, 5, 4), "mixed"), ((1, 1, 1), "mixed")])
def test_cluster_class(spark, args, want):
    assert one(spark, X.cluster_class(F.col("a"), F.col("b"), F.col("c")), a=args[0], b=args[1], c=args[2]) == want


@pytest.mark.parametrize("chars,want", [(200, 1.0), (25, 0.5), (8000, 0.5), (1, 0.1)])
def test_length_sanity(spark, chars, want):
    assert one(spark, scores.length_sanity(F.col("n")), n=chars) == want


def test_priority(spark):
    now = F.lit("2024-05-01").cast("timestamp")
    full = scores.priority(F.lit(100000), now, F.lit(10), F.lit(True), F.lit("FCC"), now)
    low = scores.priority(F.lit(1000), F.lit("2024-02-01").cast("timestamp"), F.lit(0), F.lit(False), F.lit("FDA"), now)
    assert one(spark, full) == 100.0 and 1.0 <= one(spark, low) <= 2.5


def test_html_text(spark):
    rows = spark.createDataFrame([("<div>Hello <b>World</b>!</div>",), (None,), ("",), ("<script>x</script>a &amp; b<!-- c -->",)], "h string")
    assert [r.x for r in rows.select(clean_html("h").alias("x")).collect()] == ["Hello World!", None, None, "a & b"]
    assert html_text("<p>a<style>b</style>c") == "ac"


def test_ratio_never_passes_its_bound(spark):
    pairs = [("abcd", "bcde"), ("", ""), ("a", ""), ("the innovation", "the innovations of it")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", ratio_bound(F.col("a"), F.col("b")).alias("m")).collect()
    assert all(ratio(r.a, r.b) <= r.m + 1e-12 for r in rows)


def test_exact_clusters(spark):
    rows = [(f"c{i}", "D", h, t) for i, (h, t) in enumerate([("a", "xx"), ("a", "xx"), ("b", "y"), ("b", "yy"), ("b", "yy"), ("c", "z"), (None, None)])]
    clusters, members = C.exact_clusters(spark.createDataFrame(rows, "comment_id string, docket_id string, text_hash string, normalized_text string"))
    assert sorted(r.cluster_size for r in clusters.collect()) == [2, 3] and members.count() == 5
    b = clusters.where("text_hash = 'b'").first()
    assert b.representative_comment_id == "c3"
    assert b.cluster_id == hashlib.sha256("v1_exact_hash|D|b|['c2', 'c3', 'c4']".encode()).hexdigest()
    assert [r.comment_id for r in members.where("text_hash = 'b'").orderBy("membership_rank").collect()] == ["c3", "c2", "c4"]


def _unit(spark, vectors):
    rows = [(f"c{i}", "D", [float(x) for x in v]) for i, v in enumerate(vectors)]
    return N.normalized(spark.createDataFrame(rows, "comment_id string, docket_id string, v array<double>"))


@pytest.mark.parametrize("blocks", [1, 3])
def test_similar_pairs_and_components(spark, blocks):
    rows = _unit(spark, [(1, 0), (0.99, 0.01), (0, 1), (0.01, 0.99), (-1, 0)])
    pairs = N.similar_pairs(rows, 0.92, blocks)
    assert sorted((r.a, r.b) for r in pairs.collect()) == [("c0", "c1"), ("c2", "c3")]
    assert sorted(r["count"] for r in C.components_of(pairs).groupBy("component").count().collect()) == [2, 2]


def test_pairs_equal_brute_force(spark):
    v = np.random.default_rng(1).normal(size=(120, 6))
    rows = _unit(spark, v)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {tuple(sorted((f"c{i}", f"c{j}"))) for i in range(120) for j in range(i) if u[i] @ u[j] >= 0.7}
    got = [(r.a, r.b) for r in N.similar_pairs(rows, 0.7, 5).collect()]
    assert set(got) == want and len(got) == len(want)


def test_medoid(spark):
    rows = _unit(spark, [(1, 0), (0.99, 0.01), (0.98, 0.02)]).withColumn("component", F.lit("k"))
    ranked = C.ranked(C.medoids(rows))
    first = ranked.where("membership_rank = 1").first()
    assert first.comment_id == first.representative_comment_id == "c1"


def test_vectors_that_can_not_be_scaled(spark):
    for bad in ([(0, 0)], [(1, 0), (1, 0, 0)]):
        with pytest.raises(Exception, match="vector"):
            _unit(spark, bad).collect()


def test_mock_embeddings_are_unit_and_the_same(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",)], "t string").select(mock_embedding(8)("t").alias("v")).collect()
    assert rows[0] == rows[1] != rows[2] and abs(np.linalg.norm(rows[0].v) - 1) < 1e-6


def test_attributions(spark):
    clusters = spark.createDataFrame([("k1", "We all support the great innovation plan for everyone."), ("k2", "nothing to see"), ("k3", "the great innovations plan for everyone")], "cluster_id string, text string")
    registry = spark.createDataFrame([("Acme", "the GREAT  innovation plan", 0), ("Acme", "plan for everyone", 1), ("Bloc", "the great innovation plan for everyone", 0), ("None", None, 0)], "entity_name string, phrase string, ord int")
    got = {(r.cluster_id, r.entity_name): r for r in V.attributions(clusters, registry).collect()}
    assert len(got) == 6
    hit = got["k1", "Acme"]
    assert (hit.evidence_type, hit.confidence_score, hit.confidence_label, hit.matched_phrase) == ("exact_phrase_match", 0.95, "high", "the GREAT  innovation plan")
    fuzzy = got["k3", "Bloc"]
    assert (fuzzy.evidence_type, fuzzy.confidence_label) == ("fuzzy_phrase_match", "medium")
    assert (got["k2", "Bloc"].evidence_type, got["k2", "Bloc"].confidence_label) == ("known_campaign_registry", "needs_review")
    want = hashlib.sha256(b"k2\0Bloc\0\0known_campaign_registry\0").hexdigest()
    assert got["k2", "Bloc"].attribution_id == want


def test_migrations(spark):
    text = "The commission must protect small farms from this harmful new burden now. Too short. We ask that the agency withdraw this proposed rule at once please."
    clusters = spark.createDataFrame([("k", text)], "cluster_id string, text string")
    rules = spark.createDataFrame([(0, "A", "Other words entirely here."), (1, "B", "We hold that the Commission must protect small farms from this harmful new burden now. Done."), (2, "C", "We ask the agency to withdraw this proposed rule at once please.")], "ord int, section string, body string")
    got = {r.cluster_phrase: r for r in V.migrations(V.rule_matches(clusters, rules), "doc").collect()}
    exact = got["The commission must protect small farms from this harmful new burden now."]
    assert (exact.match_type, exact.section, exact.claim_scope, exact.confidence_label) == ("exact", "B", "possible_influence", "high")
    near = got["We ask that the agency withdraw this proposed rule at once please."]
    assert near.section == "C" and near.match_type in ("near_exact", "semantic") and near.claim_scope == "phrase_overlap"


def test_concentration(spark):
    rows = spark.createDataFrame([("a", "2024-01-01 10:05:00"), ("a", "2024-01-01 10:55:00"), ("b", "2024-01-01 10:00:00"), ("b", "2024-01-01 11:00:00"), ("c", None)], "who string, ts string")
    found = E.concentration(rows.withColumn("ts", F.col("ts").cast("timestamp")), "who", "ts").collect()
    assert {r.who: round(r.temporal_score, 6) for r in found} == {"a": 1.0, "b": 0.0}


def test_purity(spark):
    phrase = "This exact sentence is repeated by many people everywhere."
    rows = spark.createDataFrame([("k", f"{phrase} One.", 0), ("k", f"Two. {phrase}", 1), ("k", "Nothing alike in this one at all.", 2)], "k string, t string, o int")
    assert E.purity(rows, "k", "t", "o", top=1).first().purity == 0.6667


def test_token_overlap_has_every_item(spark, sf):
    from canvass.queries import QUERIES

    tokens = lambda t: [w for w in re.split("[^a-z0-9]+", t.lower()) if len(w) >= 2]
    items = [(r.item_id, tokens(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [(r.doc_id, set(tokens(r.text))) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {(i, d) for i, t in items for d, words in docs if t and sum(w in words for w in t) / len(t) >= 0.7}
    assert {(r.item_id, r.doc_id) for r in QUERIES["X19_token_overlap"](spark, sf).collect()} == want
    assert any(i >= 5 for i, _ in want)
