"""Mixing sources to target weights (operator 9): nested budget thresholds from hash histograms.

Every document gets a fixed 60-bit hash. For each source, words are summed by the leading
bits of the hash; the running sum over those buckets shows in which bucket the budget ends,
and only that bucket is summed again by its next bits, until the threshold is one hash value.
A filter by hash then takes the documents: nothing is sorted, and a larger budget always
takes a superset of a smaller one. Budgets above a source's size take whole copies first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canvass.llm.common import stored, table, word_count

HASH_BITS = 60
LEVEL_BITS = 12
MAX_REPEATS = 3
#: The table of cuts has a row per source and is broadcast up to this many of them, else joined with salt.
BROADCAST_SOURCES = 20_000
SALT = 64


def document_hash(doc_id: str = "doc_id", text: str = "text"):
    """60 bits of MD5 of the id in decimal; of the text where the id is null."""
    key = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text:"), F.coalesce(F.col(text), F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Budget of every source: ``source, source_size, target``.

    Sources by code point, nulls last, weigh 1, 2, 3 and so on again. The budgets share the sum
    of all sizes by weight; one that would pass ``max_repeats`` times its source stops there
    and the others share its excess by weight, until none is above.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = _ranked(per).withColumn("weight", F.col("rank") % 3 + 1).withColumn("cap", max_repeats * F.col("source_size"))
    per = stored(per, "sources")
    total, weight, free = per.agg(F.sum("source_size"), F.sum("weight"), F.count(F.lit(1))).first()
    level = total / weight if weight else 0.0
    stops = lambda level: F.col("cap") <= F.lit(level) * F.col("weight")
    while free:  # one aggregation a round; the level only rises, and rests when no further source stops
        capped, lighter, left = per.agg(F.sum(F.when(stops(level), F.col("cap"))), F.sum(F.when(~stops(level), F.col("weight"))), F.count_if(~stops(level))).first()
        if left in (0, free):
            break
        free, level = left, (total - capped) / lighter
    return per.select(
        "source", "source_size",
        F.when(stops(level), F.col("cap").cast("double")).otherwise(F.lit(level) * F.col("weight")).alias("target"),
    )


def _ranked(per: DataFrame) -> DataFrame:
    """Adds ``rank``, the place of a source by code point from 0, nulls last, without one task for all of them."""
    # The id holds the number of the sorted partition above the place in it.
    placed = stored(per.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "sorted")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    ends = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    ends = ends.select("part", F.coalesce(before, F.lit(0)).alias("before"))  # a row for each shuffle partition
    return placed.join(F.broadcast(ends), part == F.col("part")).withColumn("rank", F.col("before") + place).drop("at", "part", "before")


def mixing_plan(docs: DataFrame, max_repeats: int = MAX_REPEATS) -> tuple[DataFrame, DataFrame, bool]:
    """Sizes by document, the plan by source (``of, source_size, target, whole, cut``), and whether the plan is small."""
    sizes = stored(
        docs.select("doc_id", "source", document_hash().alias("hash"), word_count("text").alias("size")), "sizes"
    )
    budgets = stored(
        targets(sizes, max_repeats)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")),
        "budgets",
    )
    small = budgets.count() <= BROADCAST_SOURCES
    cuts = _thresholds(sizes, budgets.where("rest > 0").select("source", "rest"), small)
    plan = budgets.join(cuts, budgets.source.eqNullSafe(cuts.cut_source), "left").select(
        F.col("source").alias("of"), "source_size", "target", "whole",
        F.coalesce("cut", F.lit(-1).cast("long")).alias("cut"),
    )
    return sizes, stored(plan, "plan"), small


COPIES = "whole + cast(hash <= cut as long)"


def mix(docs: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """How often the mix takes each document: ``doc_id, source, size, source_size, target, copies``.

    Each source gives its documents floor(target / size) times whole, and once more those
    whose hash is at most the source's threshold: the hash at which the running sum comes nearest
    to what is left (the smaller one in a tie). Rows with the same hash (repeated ids) go together.
    Null or empty text has size 0, a null source is a source of its own, and a null id takes its
    hash from the text. Other columns of ``docs`` are not read; an empty table gives an empty
    one. The result is the same on every run.
    """
    sizes, plan, small = mixing_plan(docs, max_repeats)
    return _per_source(sizes, plan, small).select(
        "doc_id", "source", "size", "source_size", "target", F.expr(COPIES).alias("copies")
    )


def mixed(docs: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the mix takes it (zero times: left out).

    The texts are not shuffled: the plan has one row per source.
    """
    _, plan, small = mixing_plan(docs, max_repeats)
    own = [F.col(f"row.{c}") for c in docs.columns]
    rows = docs.select(F.struct(*docs.columns).alias("row"), "source", document_hash().alias("hash"))
    taken = _per_source(rows, plan, small).withColumn("copies", F.expr(COPIES)).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*own)


def _per_source(rows: DataFrame, per: DataFrame, small: bool) -> DataFrame:
    """Join ``per`` (one row per source, named ``of``): broadcast where its size allows, else over salted keys."""
    if small:
        return rows.join(F.broadcast(per), rows.source.eqNullSafe(per.of)).drop("of")
    rows = rows.withColumn("salt", F.pmod("hash", F.lit(SALT)))
    per = per.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    same = rows.source.eqNullSafe(per.of) & (rows.salt == per.of_salt)
    return rows.join(per, same).drop("of", "of_salt", "salt")


def _thresholds(sizes: DataFrame, rests: DataFrame, small: bool) -> DataFrame:
    """The last hash taken of every source with something left to fill: ``cut_source, cut``."""
    state = rests.select(
        F.col("source").alias("of"), F.lit(0).cast("long").alias("prefix"),
        F.col("rest").alias("need"), F.lit(-1).cast("long").alias("before"),
    )
    for done in range(LEVEL_BITS, HASH_BITS + 1, LEVEL_BITS):
        rows = _per_source(sizes.where("size > 0"), state.select("of", "prefix", "need", "before"), small)
        rows = rows.where(F.shiftright("hash", HASH_BITS - done + LEVEL_BITS) == F.col("prefix"))
        sums = rows.groupBy("source", "need", "before", F.shiftright("hash", HASH_BITS - done).alias("bucket")).agg(
            F.sum("size").alias("words"), F.max("hash").alias("top"), F.min("hash").alias("low")
        )
        upto = W.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("run", F.sum("words").over(upto)).withColumn("under", F.lag("top").over(upto))
        # What lies before the boundary bucket is taken; the need left is to be met inside it.
        edge = sums.where("run >= need and run - words < need").select(
            F.col("source").alias("of"), F.col("bucket").alias("prefix"),
            (F.col("need") - (F.col("run") - F.col("words"))).alias("need"),
            F.coalesce("under", "before").alias("before"), "words", "top", "low",
        )
        state = stored(edge, "edge")
        if state.where("low <> top").isEmpty():
            break
    nearer = F.col("words") - F.col("need") < F.col("need")
    return state.select(
        F.col("of").alias("cut_source"), F.when(nearer, F.col("top")).otherwise(F.col("before")).alias("cut")
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


#: The same mix with a running sum over all hashes in order; rows with one hash go together there too.
OP9_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'text:' || coalesce(text, ''))), 1, 15))::BIGINT AS hash,
         len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))::BIGINT AS size
  FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sizes GROUP BY source
), levels AS (
  SELECT *, 3 * source_size AS cap,
         (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER w, 0))::DOUBLE
           / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS level
  FROM per WINDOW w AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), aims AS (
  SELECT source, source_size,
         CASE WHEN cap <= level * weight THEN cap::DOUBLE
              ELSE max(CASE WHEN cap > level * weight THEN level END) OVER () * weight END AS target
  FROM levels
), budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM aims
), hashes AS (
  SELECT source, hash, sum(size)::BIGINT AS words FROM sizes WHERE size > 0 GROUP BY source, hash
), runs AS (
  SELECT source, hash, words, sum(words) OVER (PARTITION BY source ORDER BY hash) AS run FROM hashes
), extra AS (
  SELECT r.source, max(r.hash) AS cut
  FROM runs r JOIN budgets b ON r.source IS NOT DISTINCT FROM b.source
  WHERE b.target - b.whole * b.source_size > 0
    AND (r.run < b.target - b.whole * b.source_size
         OR (r.run - r.words < b.target - b.whole * b.source_size
             AND r.run - (b.target - b.whole * b.source_size) < (b.target - b.whole * b.source_size) - (r.run - r.words)))
  GROUP BY r.source
)
SELECT s.doc_id, s.size, b.source_size, b.target,
       (s.size * (b.whole + CASE WHEN s.hash <= coalesce(e.cut, -1) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sizes s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
LEFT JOIN extra e ON s.source IS NOT DISTINCT FROM e.source
"""
