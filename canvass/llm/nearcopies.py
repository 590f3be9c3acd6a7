"""Near copies by SimHash (operator 8's wider form): pigeonring candidates, full Hamming check, exact Jaccard check.

Two texts link if one of their two fingerprints differs in ``MAX_BITS`` or fewer and their five-word shingles
have a Jaccard similarity of 0.8 or more. The fingerprints are SimHashes of a text's distinct
words, as one changed word changes five shingles but one word only: near copies are then
a few bits apart where SimHashes of five-word shingles are ten.

Pigeonring: on a ring of segments some chain of every length differs in no more than its share of the bits,
from each prefix on. The first two segments of that chain are the bucket's key; one side comes under its own key, the
other also under the keys within the chain's budget. What differs in few enough bits of the whole is compared exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.llm.common import first_of_each, freeing, small_batches, small_broadcasts, stored
from canvass.llm.simhash import _LOWER, _signed, segment_masks
from canvass.operators.components import connected_components

SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: Fingerprints of a text, the bits they may differ in, and segments on the ring.
TABLES, MAX_BITS, SEGMENTS, CHAIN = 2, 6, 7, 2
#: Buckets with more texts than this near their middle are compared by stars first, and in pairs only between what the stars
#: leave apart. (Buckets that are only full of texts far from each other give few pairs, however many meet there.)
CROWD = 8
#: Longs of the odd bits by which such pairs are bounded before they are compared.
ODD = 16
#: Words or shingles whose bits are counted at once.
_BLOCK = 1 << 14


def words_of(text: str | None) -> list[bytes]:
    """The text's words in lower case (A to Z)."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def _majority(digests: list[bytes], longs: int) -> list[int]:
    """For each bit whether over half of the digests have it, as signed longs."""
    counts = np.zeros(64 * longs, np.int64)
    for at in range(0, len(digests), _BLOCK):
        bits = np.frombuffer(b"".join(digests[at : at + _BLOCK]), np.uint8).reshape(-1, 8 * longs)
        counts += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(digests), bitorder="little").view("<i8").tolist()


def word_fingerprints(text: str | None) -> list[int]:
    """``TABLES`` independent SimHashes of the distinct words; zeros for a text without words."""
    return _majority([xxhash.xxh3_128_digest(w) for w in set(words_of(text))], TABLES)


def shingles(text: str | None, size: int = SHINGLE_WORDS) -> list[bytes]:
    """Distinct shingles (a text of fewer words is one shingle, one without words has none)."""
    words = words_of(text)
    k = min(size, len(words))
    return list({b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}) if words else []


def shingle_hashes(text: str | None) -> np.ndarray:
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, shingles(text)), np.uint64))


def odd_bits(hashes: np.ndarray, longs: int = ODD) -> list[int]:
    """Bit j is 1 if an odd number of the hashes leave j: two sets differ in as many elements at least as these differ in bits."""
    odd = np.bincount((hashes % np.uint64(64 * longs)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


def most_apart(both_sizes, similarity: float):
    """In how many elements two sets differ at most if they are as similar as that; ``both_sizes`` is the sum of their sizes."""
    return both_sizes * (1 - similarity) / (1 + similarity) + 1e-6


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets; 1 if both are empty."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(a) else 0
    union = len(a) + len(b) - both
    return both / union if union else 1.0


def chain_flips(max_bits: int, segments: int, length: int) -> list[tuple[int, list[int]]]:
    """For each start on the ring, the mask of its chain and what a text may differ by there (nothing first)."""
    masks = segment_masks(segments)
    bits = [[1 << j for j in range(64) if m >> j & 1] for m in masks]
    budget = [n * max_bits // segments for n in range(1, length + 1)]
    out = []
    for start in range(segments):
        ring = [(start + j) % segments for j in range(length)]
        flips = [(0, 0)]
        for segment, most in zip(ring, budget):
            flips = [
                (used + n, flip | sum(some)) for used, flip in flips for n in range(most - used + 1) for some in combinations(bits[segment], n)
            ]
        out.append((sum(masks[i] for i in ring), sorted((f for _, f in flips), key=lambda f: (f.bit_count(), f))))
    return out


def _row(slot: int, fp: Column, key: Column) -> Column:
    return F.struct(F.lit(slot).alias("slot"), key.alias("key"), fp.alias("fp"))


def _rows(own: Column, flips: list[int]) -> Column:
    """The same row under the key with each of the flips."""
    keys = F.array(*[F.lit(_signed(f)) for f in flips])
    return F.transform(keys, lambda f: F.struct(own["slot"].alias("slot"), own["key"].bitwiseXOR(f).alias("key"), own["fp"].alias("fp")))


def _keyed(nodes: DataFrame, max_bits: int, segments: int, chain: int) -> tuple[DataFrame, DataFrame]:
    """``slot, key, node, fp`` of every text under its own keys, and under all keys within the budgets."""
    own, near = [], []
    for t in range(TABLES):
        for i, (mask, flips) in enumerate(chain_flips(max_bits, segments, chain)):
            own.append(_row(t * segments + i, F.col(f"fp{t}"), F.col(f"fp{t}").bitwiseAND(F.lit(_signed(mask)))))
            near.append(_rows(own[-1], flips))
    exploded = lambda c: nodes.select("node", F.explode(c).alias("k")).select("k.*", "node")
    return exploded(F.array(*own)), exploded(F.concat(*near))


def _pairs(a: DataFrame, b: DataFrame, on: list[str], near: Callable[[Callable, Callable], Column]) -> DataFrame:
    """Distinct pairs ``a, b`` of different nodes that share a bucket and for which ``near(x, y)`` holds (x and y: columns of each side)."""
    x, y = (lambda c: F.col(f"x_{c}")), (lambda c: F.col(f"y_{c}"))
    a = a.select(*on, *[F.col(c).alias(f"x_{c}") for c in a.columns if c not in on])
    b = b.select(*on, *[F.col(c).alias(f"y_{c}") for c in b.columns if c not in on])
    rows = a.join(b, on).where((x("node") != y("node")) & near(x, y))
    return rows.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()


def _within(max_bits: int) -> Callable[[Callable, Callable], Column]:
    return lambda x, y: F.bit_count(x("fp").bitwiseXOR(y("fp"))) <= max_bits


def _first_met(x: Callable, y: Callable, max_bits: int, segments: int, chain: int) -> Column:
    """Whether two texts are not within ``max_bits`` in a bucket of a slot before this one."""
    masks, budget, out = segment_masks(segments), [n * max_bits // segments for n in range(1, chain + 1)], F.lit(True)
    for t in range(TABLES):
        differ = x(f"fp{t}").bitwiseXOR(y(f"fp{t}"))
        for i in range(segments):
            met = F.bit_count(differ) <= max_bits
            for n in range(chain):
                part = sum(masks[(i + j) % segments] for j in range(n + 1))
                met = met & (F.bit_count(differ.bitwiseAND(F.lit(_signed(part)))) <= budget[n])
            out = out & ((F.col("slot") <= t * segments + i) | ~met)
    return out


def _middles(own: DataFrame, max_bits: int, crowd: int) -> DataFrame:
    """``slot, key, node, fp`` of the text nearest to the bucket's majority, bit by bit, of buckets with over ``crowd`` texts near it."""
    low = (1 << 32) | 1  # two bits of a fingerprint are counted in one long
    bits = lambda j: F.shiftrightunsigned("fp", j).bitwiseAND(F.lit(low))
    count = lambda j: F.shiftrightunsigned(f"b{j % 32}", j // 32 * 32).bitwiseAND(F.lit((1 << 32) - 1))
    full = own.groupBy("slot", "key").count().where(F.col("count") > crowd).select("slot", "key")
    own = stored(own.join(full, ["slot", "key"], "left_semi"), "full")
    votes = own.groupBy("slot", "key").agg(F.count(F.lit(1)).alias("n"), *[F.sum(bits(j)).alias(f"b{j}") for j in range(32)])
    middle = F.lit(0).cast("long")
    for j in range(64):
        middle = middle.bitwiseOR(F.when(count(j) * 2 > F.col("n"), F.lit(_signed(1 << j))).otherwise(F.lit(0).cast("long")))
    far = F.bit_count(F.col("fp").bitwiseXOR(F.col("middle")))
    found = own.join(votes.select("slot", "key", middle.alias("middle")), ["slot", "key"]).groupBy("slot", "key").agg(
        F.count_if(far <= max_bits).alias("near"), F.min(F.struct(far.alias("far"), "node", "fp")).alias("head")
    )
    return found.where(F.col("near") > crowd).select("slot", "key", "head.node", "head.fp")


def _crowds(own: DataFrame, heads: DataFrame, max_bits: int, segments: int, chain: int) -> DataFrame:
    """``slot, key, node, fp, own, head, head_fp``: the texts of crowded buckets under each bucket that they meet, with its middle.

    Texts of a bucket that is not crowded meet all others there, so only crowded buckets need meet each other; and as what two
    keys differ by is the same from either, only the one with the smaller key takes the other's texts. ``own`` says whose bucket it is.
    """
    flips = [F.array(*[F.lit(_signed(f)) for f in flips]) for _, flips in chain_flips(max_bits, segments, chain)]
    around = heads.withColumnsRenamed({"key": "bucket", "node": "head", "fp": "head_fp"})
    around = around.withColumn("flip", F.explode(F.array(*flips)[F.col("slot") % segments])).withColumn("key", F.col("bucket").bitwiseXOR(F.col("flip")))
    around = around.where("key >= bucket").join(heads.select("slot", "key"), ["slot", "key"], "left_semi")
    rows = own.join(around, ["slot", "key"])
    return rows.select("slot", F.col("bucket").alias("key"), "node", "fp", (F.col("flip") == 0).alias("own"), "head", "head_fp")


def _texts(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, text`` of the wanted nodes, one row each."""
    wanted = nodes.join(wanted.distinct(), "node").select("node", F.col("key").alias("of"), "least")
    rows = docs.select(_text_key().alias("of"), F.col("doc_id").alias("least_id"), "text")
    same = (rows["of"] == wanted["of"]) & rows["least_id"].eqNullSafe(wanted["least"])
    return rows.join(wanted, same).select("node", "text").dropDuplicates(["node"])


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a, b`` whose texts are similar enough, compared shingle by shingle."""
    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield x[["node"]].assign(hashes=[shingle_hashes(t).tobytes() for t in x["text"]])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            near = [jaccard(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)) >= similarity - 1e-12 for s, t in zip(x["s"], x["t"])]
            yield x.loc[near, ["a", "b"]]

    texts = _texts(docs, nodes, pairs.select(F.col("a").alias("node")).union(pairs.select("b")))
    sets = stored(texts.mapInPandas(freeing(hashed), "node long, hashes binary"), "sets")
    rows = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("s")), "a")
    rows = rows.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("t")), "b")
    return rows.select("a", "b", "s", "t").mapInPandas(freeing(compare), "a long, b long")


def _left_apart(members: DataFrame, links: DataFrame, docs: DataFrame, nodes: DataFrame, max_bits: int, segments: int, chain: int, similarity: float) -> DataFrame:
    """Pairs of crowded buckets whose ends the links so far leave in different components and that may be similar enough.

    In each bucket only those outside its largest component meet the others, so a crowd that the stars
    have joined meets nobody; and a pair counts in the first slot only in which it meets. Pairs whose odd bits
    show that their shingles differ in too many are left out; that is a bound, so no link is lost.
    """
    on, parts = ["slot", "key"], connected_components(links)
    members = members.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    members = stored(members.select(*on, "node", "fp", "own", "component"), "named")
    sizes = members.groupBy(*on, "component").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy(*on).agg(F.max(F.struct("n", "component"))["component"].alias("largest"), F.count(F.lit(1)).alias("parts"))
    mixed = stored(largest.where("parts > 1").drop("parts"), "mixed")
    rows = stored(members.join(mixed, on).withColumn("few", F.col("component") != F.col("largest")).drop("largest"), "apart")

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            sets = [shingle_hashes(t) for t in x["text"]]
            found = np.array([odd_bits(h) for h in sets], np.int64).reshape(len(sets), ODD)
            yield x[["node"]].assign(n=[len(h) for h in sets], **{f"s{i}": found[:, i] for i in range(ODD)})

    texts = _texts(docs, nodes, rows.select("node"))
    sketches = texts.mapInPandas(freeing(sketch), "node long, n long, " + ", ".join(f"s{i} long" for i in range(ODD)))
    sketches = stored(sketches.join(nodes.select("node", *[f"fp{t}" for t in range(TABLES)]), "node"), "sketches")
    # The sketches meet each node once, however many buckets it is in.
    held = rows.groupBy("node").agg(F.min("component").alias("component"), F.collect_list(F.struct(*on, "fp", "own", "few")).alias("at"))
    held = held.join(sketches, "node").withColumn("at", F.explode("at"))
    rows = stored(held.select("at.*", "node", "component", *sketches.drop("node").columns), "sketched")

    def near(x: Callable, y: Callable) -> Column:
        differ = sum((F.bit_count(x(f"s{i}").bitwiseXOR(y(f"s{i}"))) for i in range(ODD)), F.lit(0))
        few = differ <= most_apart(x("n") + y("n"), similarity)
        return (x("component") != y("component")) & _within(max_bits)(x, y) & few & _first_met(x, y, max_bits, segments, chain)

    side = lambda which: rows.where(which).drop("own", "few")
    return _pairs(side("own and few"), side("true"), on, near).union(_pairs(side("own and not few"), side("few"), on, near)).distinct()


def _text_key() -> Column:
    return F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, max_bits: int = MAX_BITS, segments: int = SEGMENTS, chain: int = CHAIN, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """``key, component, component_id`` of every distinct text, and ``key, doc_id`` of every row.

    Texts are linked if a fingerprint differs in ``max_bits`` or fewer and their shingles are as similar as
    ``similarity``; components are groups of linked texts, and ``component_id`` is the smallest id in them (null
    if all are null). Equal texts are one text; texts without words are alike, and null is empty. All pairs within a
    bucket are tried; where over ``crowd`` texts crowd around its middle, all pairs that stars leave in different
    components. Other columns of ``docs`` are not read; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            found = [word_fingerprints(t) for t in x.pop("text")]
            yield x.assign(**{f"fp{t}": np.array([f[t] for f in found], np.int64) for t in range(TABLES)})

    zero = F.lit(0).cast("long")
    schema = docs.select(_text_key().alias("key"), "doc_id", *[zero.alias(f"fp{t}") for t in range(TABLES)]).schema
    rows = stored(docs.select(_text_key().alias("key"), "doc_id", "text").mapInPandas(freeing(run), schema), "fingerprints")
    nodes = rows.groupBy("key").agg(F.min("doc_id").alias("least"), *[F.min(f"fp{t}").alias(f"fp{t}") for t in range(TABLES)])
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    own, near = _keyed(nodes, max_bits, segments, chain)
    heads = stored(_middles(own, max_bits, crowd), "heads")
    full = heads.select("slot", "key")
    plain = _pairs(own.join(full, ["slot", "key"], "left_anti"), near, ["slot", "key"], _within(max_bits))
    if full.isEmpty():
        links = stored(_verified(stored(plain, "pairs"), docs, nodes, similarity), "joined")
    else:
        members = stored(_crowds(own, heads, max_bits, segments, chain), "members")
        x = lambda c: F.col({"node": "head", "fp": "head_fp"}[c])
        stars = members.where((x("node") != F.col("node")) & _within(max_bits)(x, F.col))
        stars = stars.select(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b"))
        links = stored(_verified(stored(plain.union(stars).distinct(), "pairs"), docs, nodes, similarity), "joined")
        left = stored(_left_apart(members.drop("head", "head_fp"), links, docs, nodes, max_bits, segments, chain, similarity), "left")
        links = links.union(stored(_verified(left, docs, nodes, similarity), "rejoined"))
    parts = connected_components(links)
    texts = nodes.join(parts, "node", "left").select("key", "least", F.coalesce("component", "node").alias("component"))
    low = texts.groupBy("component").agg(F.min("least").alias("component_id"))
    return stored(texts.join(low, "component").select("key", "least", "component", "component_id"), "components"), rows


def without_near_copies(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` without near copies: of every group of ``near_copies``, the one row with the smallest id.

    Ids of null come after all others; of rows with one id, the first by the checksum of its text stays.
    """
    with small_broadcasts(docs.sparkSession):
        texts, rows = near_copies(docs, **settings)
    keyed = lambda docs: docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("own_id"), _text_key().alias("own_key"))
    return first_of_each(docs, rows, texts, keyed)
