"""URL filters (operator 1): rules by host and path, and gradient-boosted trees on lexical features.

Everything is DataFrame and SQL expressions. The trees are grown level by level from histograms
of gradients, one small aggregation for each level; the driver sees only the histograms and
keeps the splits, which become one nested CASE expression for scoring.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.llm.common import ascii_lower, stored, table

#: Bound of the labelled URLs that the trees are fitted on (chosen by a hash of the URL); their hosts have at
#: most twice as many suffixes, which are kept as hashes of 8 bytes, so the table of suffixes is below 1 MB.
MAX_LABELLED = 20_000
ROUNDS, DEPTH, BINS, RATE, SMOOTHING = 8, 3, 16, 0.4, 1.0
#: Weight of the mean in a suffix's statistics, in labelled URLs.
PRIOR = 20.0


@dataclass(frozen=True)
class Rule:
    """A verdict on a host with its subdomains, for paths that start with ``path``."""

    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Fixed by the contract of the query.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_of(url: str) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching(rules: tuple[Rule, ...], what) -> Column:
    """``what(rule)`` of the longest rule that fits columns ``host`` and ``path``, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        host = (F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)
        out = F.when(host & F.col("path").startswith(rule.path), F.lit(what(rule))).otherwise(out)
    return out


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def lexical(urls: DataFrame) -> DataFrame:
    """Adds the array ``__x`` of lexical features and ``__suffix1``, ``__suffix2`` (hashes of the host's last labels)."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    size = F.greatest(F.length(url), F.lit(1)).cast("double")
    letters = F.array_distinct(F.split(url, ""))
    share = F.transform(F.filter(letters, lambda c: c != ""), lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / size)
    entropy = F.aggregate(share, F.lit(0.0), lambda sum_, p: sum_ - p * F.log2(p))
    features = [
        F.length(url), F.length(host), F.length(path), _count(path, "/"), _count(host, r"\."),
        _count(url, "[0-9]") / size, _count(host, "[0-9]"), entropy, _count(url, "[&;]") + _count(url, r"\?"),
        _count(url, "="), _count(host, "-"), _count(path, "[^0-9A-Za-z/]"), _count(url, "#"),
        F.length(F.regexp_extract(path, r"([0-9]*)[^0-9]*$", 1)), F.length(F.element_at(F.split(path, "/"), -1)),
    ]
    return urls.withColumn("__x", F.array(*[f.cast("double") for f in features])).withColumns({
        "__suffix1": F.xxhash64(F.substring_index("host", ".", -1)), "__suffix2": F.xxhash64(F.substring_index("host", ".", -2))
    })


@dataclass
class BoostedTrees:
    """Trees as lists of (feature, threshold) by node, and leaf values by node; ``suffixes`` is a bounded table."""

    base: float = 0.0
    trees: list[tuple[dict[int, tuple[int, float]], dict[int, float]]] = field(default_factory=list)
    suffixes: DataFrame | None = None
    mean: float = 0.5

    def margin(self, x: str = "__x") -> Column:
        out = F.lit(self.base)
        for splits, leaves in self.trees:
            out = out + _walk(splits, 1, x, lambda node, leaves=leaves: F.lit(leaves[node]))
        return out


def _walk(splits: dict[int, tuple[int, float]], node: int, x: str, leaf) -> Column:
    if node not in splits:
        return leaf(node)
    feature, threshold = splits[node]
    left, right = _walk(splits, 2 * node, x, leaf), _walk(splits, 2 * node + 1, x, leaf)
    return F.when(F.col(x)[feature] <= F.lit(threshold), left).otherwise(right)


def _with_suffixes(rows: DataFrame, suffixes: DataFrame, mean: float) -> DataFrame:
    """Appends the suffix statistics to ``__x``; the table of suffixes is bounded by the sample."""
    more = []
    for name in ("__suffix1", "__suffix2"):
        own = suffixes.select(F.col("suffix").alias(name), F.col("rate").alias(f"{name}_rate"), F.col("n").alias(f"{name}_n"))
        rows = rows.join(F.broadcast(own), name, "left")
        more += [F.coalesce(F.col(f"{name}_rate"), F.lit(mean)), F.coalesce(F.col(f"{name}_n"), F.lit(0.0))]
    return rows.withColumn("__x", F.concat("__x", F.array(*more))).drop(*[f"__suffix{i}_{k}" for i in (1, 2) for k in ("rate", "n")])


def fit(labelled: DataFrame, rounds: int = ROUNDS, depth: int = DEPTH) -> BoostedTrees:
    """Boost trees on ``labelled`` (columns ``url, host, path, blocked`` 0 or 1) by logistic loss.

    At most about ``MAX_LABELLED`` of the labelled rows are used; repeated URLs count as often as they
    occur. Without rows the model blocks nothing; with one class only it follows that class.
    """
    n = labelled.count()
    if not n:
        return BoostedTrees(base=-1.0)
    scale = 1 << 30
    part = min(scale, scale * MAX_LABELLED // n + 1)
    kept = labelled.where(F.pmod(F.xxhash64("url"), F.lit(scale)) < part)
    kept = kept.groupBy("url", "host", "path", "blocked").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    kept = stored(lexical(kept).drop("url", "host", "path"), "labelled")
    total, bad = kept.select(F.sum("weight"), F.sum(F.col("weight") * F.col("blocked"))).first()
    if not total:
        return BoostedTrees(base=-1.0)
    mean = bad / total
    each = kept.select(F.explode(F.array_distinct(F.array("__suffix1", "__suffix2"))).alias("suffix"), "weight", "blocked")
    suffixes = each.groupBy("suffix").agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("blocked")).alias("bad"))
    suffixes = stored(suffixes.select("suffix", "n", ((F.col("bad") + PRIOR * mean) / (F.col("n") + PRIOR)).alias("rate")), "suffixes")
    model = BoostedTrees(math.log(max(mean, 1e-3) / max(1 - mean, 1e-3)), [], suffixes, mean)
    rows = _with_suffixes(kept, suffixes, mean)
    width = len(rows.select("__x").first()["__x"])
    steps = [i / BINS for i in range(1, BINS)]
    cuts = rows.select(*[F.percentile_approx(F.col("__x")[i], steps, 1000) for i in range(width)]).first()
    cuts = [sorted(set(c)) for c in cuts]
    bins = F.array(*[_bin(F.col("__x")[i], c) for i, c in enumerate(cuts)])
    rows = rows.select(bins.alias("bins"), "weight", "blocked").groupBy("bins").agg(
        F.sum("weight").alias("weight"), F.sum(F.col("weight") * F.col("blocked")).alias("bad")
    )
    rows = stored(rows.coalesce(1), "binned")  # bounded by MAX_LABELLED
    grown: list[tuple[dict, dict]] = []
    for _ in range(rounds):
        margin = F.lit(model.base)
        for splits, leaves in grown:
            margin = margin + _walk(splits, 1, "bins", lambda node, leaves=leaves: F.lit(leaves[node]))
        p = 1 / (1 + F.exp(-margin))
        known = rows.withColumns({"g": p * F.col("weight") - F.col("bad"), "h": p * (1 - p) * F.col("weight")})
        splits, leaves = _grow(known, depth)
        grown.append((splits, leaves))
    model.trees = [({k: (f, cuts[f][b]) for k, (f, b) in splits.items()}, leaves) for splits, leaves in grown]
    return model


def _bin(x: Column, cuts: list[float]) -> Column:
    """How many cuts lie below ``x``."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut < x))


def _grow(rows: DataFrame, depth: int) -> tuple[dict[int, tuple[int, int]], dict[int, float]]:
    """One tree: splits (feature, last bin to the left) by node, and leaf values."""
    splits: dict[int, tuple[int, int]] = {}
    leaves: dict[int, float] = {}
    open_ = {1}
    for _ in range(depth):
        at = _walk(splits, 1, "bins", lambda node: F.lit(node))
        grams = rows.select(at.alias("node"), "g", "h", F.posexplode("bins").alias("f", "bin")).groupBy("node", "f", "bin")
        cells: dict = defaultdict(lambda: defaultdict(list))
        for r in grams.agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():  # nodes x features x bins
            cells[r["node"]][r["f"]].append((r["bin"], r["g"], r["h"]))
        parents, open_ = open_, set()
        for node in sorted(parents):
            sums = cells[node][0]
            g, h = math.fsum(x[1] for x in sums), math.fsum(x[2] for x in sums)
            leaves[node] = -RATE * g / (h + SMOOTHING)
            if best := _best_split(cells[node], g, h):
                f, bin_ = splits[node] = best
                left = [x for x in cells[node][f] if x[0] <= bin_]
                for child, part in ((2 * node, left), (2 * node + 1, [x for x in cells[node][f] if x[0] > bin_])):
                    leaves[child] = -RATE * math.fsum(x[1] for x in part) / (math.fsum(x[2] for x in part) + SMOOTHING)
                    open_.add(child)
        if not open_:
            break
    return splits, leaves


def _best_split(by_feature: dict, g: float, h: float) -> tuple[int, int] | None:
    best, found = 1e-6, None
    for f in sorted(by_feature):
        left_g = left_h = 0.0
        for bin_, dg, dh in sorted(by_feature[f])[:-1]:
            left_g, left_h = left_g + dg, left_h + dh
            gain = left_g**2 / (left_h + SMOOTHING) + (g - left_g) ** 2 / (h - left_h + SMOOTHING) - g**2 / (h + SMOOTHING)
            if gain > best * (1 + 1e-9):
                best, found = gain, (f, bin_)
    return found


def parse(urls: DataFrame) -> DataFrame:
    return urls.withColumns({"host": host_of("url"), "path": path_of("url")})


def judge(urls: DataFrame, rules: tuple[Rule, ...], model: BoostedTrees) -> DataFrame:
    """``host, path, rule, verdict, block_score`` after the columns of ``urls``.

    A null URL or one without ``://`` has an empty host and path; URLs of any length are read whole. The longest
    fitting rule decides; where none fits, the trees block at a probability over one half (not at a half). Repeated
    rows keep their rows; an empty table gives an empty one. A column of ``urls`` with one of the names above is replaced.
    """
    rows = lexical(parse(urls))
    if model.suffixes is not None:
        rows = _with_suffixes(rows, model.suffixes, model.mean)
    own = F.when(F.col("block_score") > 0.5, "block").otherwise("allow")
    rows = rows.withColumn("block_score", 1 / (1 + F.exp(-model.margin()))).withColumn("rule", matching(rules, lambda r: r.text))
    rows = rows.withColumn("verdict", F.coalesce(matching(rules, lambda r: r.action), own))
    return rows.drop("__x", "__suffix1", "__suffix2")


def labelled_by(urls: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The URLs that rules decide, as labelled URLs: ``url, host, path, blocked``."""
    known = parse(urls.select("url")).withColumn("verdict", matching(rules, lambda r: r.action))
    return known.where("verdict is not null").select("url", "host", "path", (F.col("verdict") == "block").cast("int").alias("blocked"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    found = judge(pages, RULES, fit(labelled_by(pages, RULES)))
    return found.select("page_id", "host", "path", "rule", "verdict", "block_score")
