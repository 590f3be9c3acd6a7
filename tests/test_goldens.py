"""Queries that SQL can't express, against plain Python on whole small tables."""

import hashlib
import html
import re
from collections import defaultdict
from difflib import SequenceMatcher

import numpy as np
import pytest

from canvass.queries import QUERIES


def plain(text):
    return re.sub(r"\s+", " ", text).strip().lower()


@pytest.fixture(scope="module")
def read(spark, sf):
    return lambda name: [r.asDict() for r in spark.read.parquet(f"{sf}/{name}.parquet").collect()]


@pytest.fixture(scope="module")
def run(spark, sf):
    return lambda name: [tuple(r) for r in QUERIES[name](spark, sf).collect()]


def stripped(page):
    return html.unescape(re.sub(r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>", "", page))


def test_html_text(read, run):
    assert sorted(run("X5_html_text")) == sorted((p["page_id"], stripped(p["html"])) for p in read("pages"))


def test_parsed_details(read, run):
    want = []
    for p in read("pages"):
        text = plain(stripped(p["html"]))
        want.append((str(p["page_id"]), "detail_comment_text", "parsed", len(stripped(p["html"])), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(run("P5_parsed_details")) == sorted(want)


def sentences(text):
    return [s.strip() for s in re.split(r"(?<=[.!?])\s+", text)]


def phrases(text, least=6, most=30):
    """Sentences of enough words, each followed by its beginning if it is long; the first of each normalized form."""
    out, seen = [], set()
    for s in sentences(text or ""):
        words = s.split()
        if len(words) >= least:
            out.append(s)
            if len(words) > most:
                out.append(" ".join(words[:most]))
    return [(i, s) for i, s in enumerate(out) if not (plain(s) in seen or seen.add(plain(s)))]


def test_candidate_phrases(read, run):
    want = [(d["doc_id"], i, s) for d in read("documents") for i, s in phrases(d["text"])]
    assert sorted(run("X10_candidate_phrases")) == sorted(want)


def test_ratios(read, run):
    texts = [(b["item_id"], plain(b["text"])) for b in read("benchmark")]
    want = {}
    for i, a in texts:
        for j, b in texts:
            if i < j and 2 * min(len(a), len(b)) / (len(a) + len(b)) >= 0.85:
                want[i, j] = SequenceMatcher(None, a, b).ratio()
    got = {(i, j): r for i, j, r in run("X12_ratio")}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_rule_matches(spark, sf, run):
    from canvass.queries import evidence

    rules = sorted((r.ord, r.section, r.body) for r in evidence.rules(spark, sf).collect())
    want = set()
    for c in evidence.campaigns(spark, sf).collect():
        for i, phrase in phrases(c.text):
            p = plain(phrase)
            inside = next((s for _, s, body in rules if p in plain(body)), None)
            if inside is not None:
                want.add((c.cluster_id, i, inside, 1.0))
                continue
            best = None
            for _, section, body in rules:
                for s in filter(None, map(plain, sentences(body))):
                    if 2 * min(len(p), len(s)) / (len(p) + len(s)) >= 0.6:
                        ratio = SequenceMatcher(None, p, s).ratio()
                        if ratio >= 0.6 and (best is None or ratio > best[0]):
                            best = ratio, section
            if best:
                want.add((c.cluster_id, i, best[1], round(best[0], 6)))
    assert set(run("J9_N10_rule_matches")) == want and want


def test_migrations_are_the_best_matches(run):
    rows, matches = run("M13_migrations"), defaultdict(list)
    for cluster, i, section, ratio in run("J9_N10_rule_matches"):
        matches[cluster].append((-ratio, i, section))
    got = defaultdict(list)
    for _, cluster, section, *_ in rows:
        got[cluster].append(section)
    assert got.keys() == matches.keys() and len({r[0] for r in rows}) == len(rows)
    for cluster, found in matches.items():
        best = [section for _, _, section in sorted(found)[:5]]
        assert len(got[cluster]) <= len(best) and set(got[cluster]) == set(best)


def test_mock_vectors(read, run):
    got = dict(run("M9_mock_embeddings"))
    for d in read("documents"):
        seed = int.from_bytes(hashlib.sha256((d["text"] or "").encode()).digest()[:8], "big")
        v = np.random.default_rng(seed).normal(size=8)
        assert np.allclose(got[d["doc_id"]], v / np.linalg.norm(v), atol=1e-6)


def test_samples_and_redaction(read, run):
    assert run("T7_seeded_sample") == run("T7_seeded_sample") and len(run("T7_seeded_sample")) == 3
    got = dict(run("X27_redaction"))
    for p in read("pages"):
        assert got[p["page_id"]] == re.sub(r"\b[a-z]+://[^\s/]*", "[host]", re.sub(r"\b[0-9a-fA-F]{16,}\b", "[id]", "failed at " + p["url"]))
