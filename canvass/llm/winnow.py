"""Document fingerprints (operator 6): winnowing in DataFrame expressions.

A text is its lower-case words. Each run of K words has a polynomial hash, built for all places at
once by doubling; of every W neighbouring hashes the smallest is chosen, the rightmost of equal ones,
and kept with its position. Two texts that share K + W - 1 words in a row share a fingerprint.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W_
from pyspark.sql import functions as F

from canvass.llm.common import table

K, W = 5, 6
#: A prime below 2^31, so that products stay within 64 bits, and the base of the polynomial.
PRIME, BASE = (1 << 31) - 1, 1_000_003
_POSITION = (1 << 31) - 1
#: Documents to a range of ids while there are few ranges, and at most when there are more.
RANGE_ROWS, FEW_RANGES, FULL_RANGE = 125, 2048, 20_000


def _indexed(size: Column, at) -> Column:
    """``at(i)`` for i from 0 below ``size``; empty if there is none."""
    return F.when(size > 0, F.transform(F.sequence(F.lit(0), size - 1), at)).otherwise(F.array().cast("array<bigint>"))


def _join(high: Column, low: Column, power: int) -> Column:
    return (high * pow(BASE, power, PRIME) + low) % PRIME


def with_fingerprint(rows: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: the chosen hashes with their positions, packed into longs, in the order of the text.

    A packed long has the hash above the position counted down, so its smallest value is the smallest
    hash at the rightmost place. Texts shorter than K words have one hash over all their words; null,
    empty and blank texts have none.
    """
    keep, v = rows.columns, lambda name: f"__{out}_{name}"
    bare = F.btrim(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(F.length(bare) > 0, F.split(bare, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn(v("h"), F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(PRIME))))
    h, g2, g4, g5 = F.col(v("h")), F.col(v("g2")), F.col(v("g4")), F.col(v("g5"))
    rows = rows.withColumn(v("g2"), _indexed(F.size(h) - 1, lambda i: _join(h[i], h[i + 1], 1)))
    rows = rows.withColumn(v("g4"), _indexed(F.size(g2) - 2, lambda i: _join(g2[i], g2[i + 2], 2)))
    rows = rows.withColumn(v("g5"), F.when(
        F.size(h) >= K, _indexed(F.size(g4) - 1, lambda i: _pack(_join(g4[i], h[i + 4], 1), i))
    ).when(F.size(h) > 0, F.array(_pack(F.aggregate(h, F.lit(0).cast("long"), lambda a, x: _join(a, x, 1)), F.lit(0))))
     .otherwise(F.array().cast("array<bigint>")))
    lowest = _indexed(F.greatest(F.size(g5) - (W - 1), F.least(F.size(g5), F.lit(1))), lambda i: F.array_min(F.slice(g5, i + 1, W)))
    return rows.withColumn(out, F.array_distinct(lowest)).select(*keep, out)


def _pack(hash_: Column, position: Column) -> Column:
    return F.shiftleft(hash_, 31) + (F.lit(_POSITION) - position)


def unpacked(packed: Column) -> Column:
    """Array of (hash, position) from packed longs."""
    return F.transform(packed, lambda x: F.struct(
        F.shiftright(x, 31).alias("hash"), (F.lit(_POSITION) - x.bitwiseAND(F.lit(_POSITION))).alias("position")
    ))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``fingerprint`` (array of hash and position) of every row, from the whole text."""
    rows = with_fingerprint(docs.select("doc_id", "text"), "text", "packed")
    return rows.select("doc_id", unpacked(F.col("packed")).alias("fingerprint"))


def _hashes(packed: str) -> Column:
    return F.array_distinct(F.transform(packed, lambda x: F.shiftright(x, 31)))


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of the sets of hashes in two array columns; 1 if both are empty."""
    both, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(union > 0, both / union).otherwise(1.0)


def _ranges(keys: DataFrame) -> list[list[int]]:
    """Bounds that cut column ``k`` into ranges of similar numbers of rows, in two levels: the first list has the
    bounds of the coarse ranges, and the others those inside each.
    """
    n = keys.count()
    parts = max(min(FEW_RANGES, n // RANGE_ROWS), -(-n // FULL_RANGE))
    if parts <= 1:
        return [[], []]
    wide = max(1, round(parts**0.5))
    cut = lambda m: F.percentile_approx("k", [i / m for i in range(1, m)], 50 * m)
    coarse = sorted(set(keys.select(cut(wide)).first()[0])) if wide > 1 else []
    fine: list[list[int]] = [[] for _ in range(len(coarse) + 1)]
    m = -(-parts // len(fine))
    if m > 1:
        for r in keys.groupBy(_place(coarse, F.col("k")).alias("c")).agg(cut(m).alias("b")).collect():
            fine[r["c"]] = sorted({b for b in r["b"] if r["c"] == len(coarse) or b < coarse[r["c"]]})
    return [coarse, *fine]


def _constant(values: list, kind: str) -> Column:
    """One literal, however many values it has: the parser's result is folded into the plan."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def _place(bounds: list[int], k: Column) -> Column:
    """How many bounds lie below ``k``."""
    return F.size(F.filter(_constant(bounds, "array<bigint>"), lambda b: b < k))


def _range_of(levels: list[list[int]], k: Column) -> Column:
    """The number of the range of ``k``, from 0: of the coarse range's first and its place inside."""
    coarse, *fine = levels
    first = [sum(len(f) + 1 for f in fine[:i]) for i in range(len(fine))]
    at = _place(coarse, k) + 1
    inside = F.element_at(_constant(fine, "array<array<bigint>>"), at)
    return F.element_at(_constant(first, "array<bigint>"), at).cast("int") + F.size(F.filter(inside, lambda b: b < k))


def with_next(docs: DataFrame, prepare=lambda rows: rows, carry: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``next_text``, the text of the next document by descending id; after the last comes the first.

    The ids are cut into ranges; in each, the head of the next range stands at the end for a while,
    so a window over ranges sees every neighbour, and each text is shuffled once. ``prepare`` adds
    columns after that shuffle, and those named in ``carry`` come as ``next_...`` too. Equal ids are ordered by text;
    null ids come last, by descending hash of the text, then by text.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keys = docs.select(F.col("doc_id").cast("long").alias("k"))
    named, unnamed = _ranges(keys.where("k is not null")), [[], []]
    if not keys.where("k is null").isEmpty():
        unnamed = _ranges(docs.where("doc_id is null").select(F.xxhash64("text").alias("k")))
    # Ranges of null ids have the numbers below zero.
    below = sum(len(f) + 1 for f in unnamed[1:])
    k = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    where = F.when(F.col("doc_id").isNotNull(), _range_of(named, k)).otherwise(_range_of(unnamed, k) - below)
    placed = docs.withColumns({"k": k, "range": where})
    heads = {r["range"]: r["head"] for r in placed.groupBy("range").agg(F.max("k").alias("head")).collect()}
    order = sorted(heads, reverse=True)
    after = [(heads[order[(i + 1) % len(order)]], order[(i + 1) % len(order)] < 0, r) for i, r in enumerate(order)]
    after = docs.sparkSession.createDataFrame(after, "head long, null_id boolean, range int")
    guests = placed.drop("range").withColumn("null_id", F.col("doc_id").isNull())
    guests = guests.join(F.broadcast(after), (guests.k == after["head"]) & (guests["null_id"] == after["null_id"])).select(*placed.columns)
    rows = placed.withColumn("guest", F.lit(False)).unionByName(guests.withColumn("guest", F.lit(True)))
    rows = prepare(rows.repartition("range"))
    by = W_.partitionBy("range").orderBy("guest", F.col("k").desc(), "text")
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(by) for c in ("text", *carry)})
    return rows.where(~F.col("guest")).drop("range", "guest", "k")


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness.

    ``doc_id, n_chars, edited, packed, edited_packed, near_edited, near_next``. In the edited text the last third (rounded down) of
    the code points gives way to the first as many of the next document. Null text counts as empty;
    a single document is its own next; repeated rows follow each other. Other columns of ``docs``
    are not read; an empty table gives an empty one.
    """
    rows = with_next(docs, lambda rows: with_fingerprint(rows, "text", "packed"), ("packed",))
    n, third = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "packed", "next_packed")
    rows = with_fingerprint(rows, "edited", "edited_packed")
    sets = rows.withColumns({"own": _hashes("packed"), "other": _hashes("edited_packed"), "next": _hashes("next_packed")})
    return sets.select(
        "doc_id", "n_chars", "edited", "packed", "edited_packed",
        likeness("own", "other").alias("near_edited"), likeness("own", "next").alias("near_next"),
    )


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda c: F.sha2(F.array_join(F.col(c).cast("array<string>"), ",").cast("binary"), 256)
    rows = compare_edited(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        digest("packed").alias("fingerprint"), digest("edited_packed").alias("edited_fingerprint"),
        "near_edited", "near_next", F.size("packed").cast("long").alias("n_hashes"),
    )
