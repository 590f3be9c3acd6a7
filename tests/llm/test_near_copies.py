"""Near copies against brute force: every pair of texts that links, whatever the size of the buckets."""

import random
from collections import defaultdict

import numpy as np
import pytest

from canvass.llm import nearcopies as near
from canvass.llm.simhash import segment_masks


def parts(nodes, edges):
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
    return groups.values()


def plain_shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def plain_links(texts):
    """Pairs of distinct texts within six bits of a fingerprint and of similarity 0.8 or more."""
    found = [(t, near.word_fingerprints(t), plain_shingles(t)) for t in texts]
    for i, (a, fa, sa) in enumerate(found):
        for b, fb, sb in found[:i]:
            if any(((x ^ y) % 2**64).bit_count() <= near.MAX_BITS for x, y in zip(fa, fb)) and len(sa & sb) >= 0.8 * len(sa | sb):
                yield a, b


def some_texts(crowd):
    rng = random.Random(crowd)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(300)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 150))) for _ in range(60)]
    for base in texts[:8] + texts[:1] * crowd:
        words = base.split()
        for _ in range(1 + rng.randrange(3)):
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    return texts + ["", " \n", "One two", "one TWO", "a b c d e f", "f e d c b a"]


def test_some_chain_of_every_length_stays_within_its_budget():
    rng, masks = random.Random(1), segment_masks(near.SEGMENTS)
    for length in (1, 2, 3):
        rings = near.chain_flips(near.MAX_BITS, near.SEGMENTS, length)
        for _ in range(400):
            x = sum(1 << j for j in rng.sample(range(64), near.MAX_BITS))
            assert any(x & mask in flips for mask, flips in rings)
        budget = [n * near.MAX_BITS // near.SEGMENTS for n in range(1, length + 1)]
        for start, (mask, flips) in enumerate(rings):
            ring = [masks[(start + j) % near.SEGMENTS] for j in range(length)]
            assert all(sum((f & m).bit_count() for m in ring[: n + 1]) <= budget[n] for f in flips for n in range(length)) and len(set(flips)) == len(flips)


@pytest.mark.parametrize("crowd", [2, 10**6])
def test_components_are_those_of_all_links(spark, crowd):
    texts = some_texts(40)
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(1000, texts[0], "x"), (1001, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3)
    found, of = near.near_copies(docs, crowd=crowd)
    named = {r.doc_id: r.component_id for r in of.join(found, "key").collect()}
    links = list(plain_links({t or "" for _, t, _ in rows}))
    assert len(links) > 60
    want = {}
    for group in parts({t or "" for _, t, _ in rows}, links):
        ids = [i for i, t, _ in rows if (t or "") in group]
        want |= dict.fromkeys(ids, min(ids))
    assert named == want
    kept = near.without_near_copies(docs, crowd=crowd)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_odd_bits_leave_out_no_similar_pair():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 3000)
        a = np.unique(np.array([rng.getrandbits(64) for _ in range(n)], np.uint64))
        kept, new = a[: rng.randint(0, len(a))], np.array([rng.getrandbits(64) for _ in range(rng.randint(0, max(1, n // 5)))], np.uint64)
        b = np.unique(np.concatenate([kept, new]))
        differ = sum(((x ^ y) % 2**64).bit_count() for x, y in zip(near.odd_bits(a), near.odd_bits(b)))
        assert near.jaccard(a, b) < 0.8 or differ <= near.most_apart(len(a) + len(b), 0.8)


def test_crowds_lose_no_link_at_the_limit(spark):
    """Each family's texts meet its middle first; the ends hang on single links of 0.81, which nothing else connects."""
    rng, texts = random.Random(5), []
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    for _ in range(120):
        base = [word() for _ in range(100)]
        for i in range(6):
            one = [word() if j == 8 + 14 * i else w for j, w in enumerate(base)]
            end = [word() if j in (3 + 14 * i, 13 + 14 * i) else w for j, w in enumerate(one)]
            texts += [" ".join(one), " ".join(end)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found, of = near.near_copies(docs, crowd=2)
    named = {r.doc_id: r.component_id for r in of.join(found, "key").collect()}
    at = {t: i for i, t in enumerate(texts)}
    assert {i: min(at[t] for t in group) for group in parts(set(texts), plain_links(texts)) for i in (at[t] for t in group)} == named


def test_crowded_buckets_meet_once(spark, monkeypatch):
    rng, held, stored = random.Random(6), {}, near.stored
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(400)]
    base = [rng.choice(vocabulary) for _ in range(200)]
    texts = list(dict.fromkeys(" ".join(rng.choice(vocabulary) if rng.random() < 0.02 else w for w in base) for _ in range(150)))

    def kept(df, name):
        held[name] = stored(df, name)
        return held[name]

    monkeypatch.setattr(near, "stored", kept)
    found, of = near.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    named = {r.doc_id: r.component_id for r in of.join(found, "key").collect()}
    at = {t: i for i, t in enumerate(texts)}
    assert named == {at[t]: min(at[t] for t in group) for group in parts(set(texts), plain_links(texts)) for t in group}
    masks, full = segment_masks(near.SEGMENTS), {(r.slot, r.key) for r in held["heads"].collect()}
    meets = {(r.slot, r.key, near._signed(r.fp & (masks[r.slot % near.SEGMENTS] | masks[(r.slot + 1) % near.SEGMENTS]))) for r in held["members"].collect()}
    assert any(a != b for _, a, b in meets)
    assert all((s, a) in full and (s, b) in full and (a == b or (s, b, a) not in meets) for s, a, b in meets)


def test_nulls_repeated_ids_and_no_rows(spark, docs, nothing):
    kept = near.without_near_copies(docs)
    rows = kept.collect()
    assert kept.columns == docs.columns
    texts = [r.text or "" for r in docs.collect()]
    assert len(rows) == len(list(parts(set(texts), plain_links(set(texts)))))
    assert near.without_near_copies(nothing).count() == 0
    other = spark.createDataFrame([(1, "one text of some words here"), (1, "quite another one that is alone"), (None, "one text of some words here"), (None, "a third")], "doc_id long, text string")
    assert sorted(map(str, ((r.doc_id, r.text) for r in near.without_near_copies(other).collect()))) == sorted(
        map(str, ((1, "one text of some words here"), (1, "quite another one that is alone"), (None, "a third")))
    )
