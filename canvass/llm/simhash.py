"""SimHash near-dedup (operator 8): fingerprints, pigeonring candidates, exact Hamming check, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.llm.common import first_of_each, freeing, joined_by_share, small_batches, stored, table
from canvass.operators.components import connected_components

BITS = 64
SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
#: A ring of five segments for two bits: the first two segments of the chain must agree.
SEGMENTS = 5
#: Up to this many fingerprints of a bucket are compared in pairs; larger buckets meet over single flips.
PAIRED = 48
#: Shingles whose bits are counted at once.
_BLOCK = 1 << 15


def simhash(text: str | None, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Bit j is 1 if over half of the shingles' XXH64 have it set; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle_words, len(words))
    a, b, digest = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), xxhash.xxh64_intdigest
    n, counts = len(a), np.zeros(BITS, np.int64)
    for at in range(0, n, _BLOCK):
        hashes = np.array([digest(line[i:j], seed) for i, j in zip(a[at : at + _BLOCK], b[at : at + _BLOCK])], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """``doc_id`` and ``fp`` (the 64 bits as a signed long) of every row; whole texts, null as empty."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            fp = np.array([simhash(t, shingle_words, seed) for t in x.pop("text")], np.uint64)
            yield x.assign(fp=fp.view(np.int64))

    schema = docs.select("doc_id", F.lit(0).cast("long").alias("fp")).schema
    return docs.select("doc_id", "text").mapInPandas(freeing(run), schema)


def segment_masks(segments: int = SEGMENTS) -> list[int]:
    cuts = [BITS * i // segments for i in range(segments + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def links(fps: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS) -> DataFrame:
    """Pairs ``a, b`` of distinct fingerprints (column ``fp``) that connect all that differ in ``max_bits`` or fewer.

    Pigeonring: cut into segments on a ring, two such fingerprints have a start from which every
    chain of l segments differs in l * max_bits / segments bits or fewer. The chain's
    segments with a budget below one bit must agree, which makes the bucket's key; the longer
    chains are filters before the full Hamming check. In buckets of over ``PAIRED``
    fingerprints each one meets, instead of its partners, its variants with up to max_bits / 2 flips
    outside the key: two within max_bits share such a variant, and all that share
    one are within max_bits, so a star per variant connects the same fingerprints without pairs.
    """
    if max_bits != 2:
        raise ValueError("single flips connect fingerprints two bits apart; give max_bits=2")
    masks = segment_masks(segments)
    budget = [(n * max_bits) // segments for n in range(1, segments + 1)]
    agree = sum(1 for x in budget if x == 0)
    chain = lambda i, n: sum(masks[(i + j) % segments] for j in range(n))
    key = [F.struct(F.lit(i).alias("ring"), F.col("fp").bitwiseAND(F.lit(_signed(chain(i, agree)))).alias("key")) for i in range(segments)]
    keyed = stored(fps.select("fp", F.explode(F.array(*key)).alias("k")).select("fp", "k.*"), "keyed")
    full = stored(keyed.groupBy("ring", "key").count().where("count > 1"), "buckets")
    near = keyed.join(full.where(F.col("count") <= PAIRED).select("ring", "key"), ["ring", "key"])
    x = F.col("a").bitwiseXOR(F.col("b"))
    within = F.bit_count(x) <= max_bits
    for n in range(agree + 1, segments):
        of = F.element_at(F.array(*[F.lit(_signed(chain(i, n))) for i in range(segments)]), F.col("ring") + 1)
        within = (F.bit_count(x.bitwiseAND(of)) <= budget[n - 1]) & within
    pairs = (
        near.withColumnRenamed("fp", "a").join(near.withColumnRenamed("fp", "b"), ["ring", "key"]).where("a < b").where(within)
    ).select("a", "b")
    crowd = keyed.join(full.where(F.col("count") > PAIRED).select("ring", "key"), ["ring", "key"])
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << j)) for j in range(BITS)])
    outside = F.element_at(F.array(*[F.lit(_signed(chain(i, agree))) for i in range(segments)]), F.col("ring") + 1)
    variants = crowd.select("fp", F.explode(F.filter(flips, lambda f: f.bitwiseAND(outside) == 0)).alias("flip")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant")
    )
    heads = variants.groupBy("variant").agg(F.min("fp").alias("head"), F.max("fp").alias("last")).where("head < last")
    stars = variants.join(heads, "variant").where("fp <> head").select(F.col("head").alias("a"), F.col("fp").alias("b"))
    return pairs.union(stars).distinct()


def components(docs: DataFrame, max_bits: int = MAX_BITS) -> tuple[DataFrame, DataFrame]:
    """``key, least, n, component, component_id`` of every distinct fingerprint, and ``doc_id, key`` of every row."""
    rows = stored(fingerprints(docs).withColumnRenamed("fp", "key"), "fingerprints")
    fps = stored(rows.groupBy("key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    parts = connected_components(links(fps.select(F.col("key").alias("fp")), max_bits))
    moved = fps.join(parts.withColumnRenamed("node", "key"), "key")
    low = moved.groupBy("component").agg(F.min("least").alias("component_id"))
    moved = moved.join(low, "component").select("key", "component", "component_id")
    alone = F.col("component").isNull()
    texts = fps.join(moved, "key", "left").select(
        "key", "least", "n", F.coalesce("component", "key").alias("component"), F.when(alone, F.col("least")).otherwise(F.col("component_id")).alias("component_id")
    )
    return stored(texts, "components"), rows


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fp, component_id`` of every row of ``docs``: groups of fingerprints linked at ``max_bits`` or fewer.

    ``component_id`` is the smallest id in the group, null if all are null. Empty, blank and null
    texts have fingerprint zero and link like any other; texts shorter than a shingle
    count as one. Repeated rows keep their rows; other columns of ``docs`` are not read; an empty table gives an empty one.
    Copies are met once: links are sought between distinct fingerprints only.
    """
    texts, rows = components(docs, max_bits)
    found = joined_by_share(rows, texts.select("key", "component_id", "n"), "key", "n")
    return found.select("doc_id", F.col("key").alias("fp"), "component_id")


def deduplicate(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that come first in their group: every group keeps the one row with its smallest id.

    A null id comes after all others; a group without any id keeps one row of its smallest fingerprint. Rows that
    share an id but not a group are judged apart. An empty table gives an empty one.
    """
    texts, rows = components(docs, max_bits)

    def keyed(docs: DataFrame) -> DataFrame:
        held = F.struct(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("own_id")).alias("doc_id")
        return fingerprints(docs.select(held, "text")).select("doc_id.*", F.col("fp").alias("own_key"))

    return first_of_each(docs, rows, texts, keyed)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
