"""URL filters: list rules first, then gradient-boosted trees on lexical features. DataFrame functions only.

The trees learn from the urls that a rule decides: their verdicts are the labels. Features are
length, depth, digit ratio, character entropy, parameter and sign counts, and statistics of the
host's suffixes: smoothed block rates by a hash of the suffix into a table of fixed size, so what
is broadcast does not grow with the number of hosts.

Trees are fitted level by level from histograms of gradients (one aggregation per level over a
bounded sample of the labelled urls) and applied as one CASE expression per tree.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash

#: (verdict, host, path) of the lists; a rule fits its host and all subdomains if the path starts with its own.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: The fit uses at most about this many different labelled urls, chosen by a hash and weighed by their number of rows; suffix statistics use all rows.
MAX_TRAIN = 20_000
TREES, DEPTH, RATE, BINS, LEAST, RIDGE = 8, 3, 0.4, 16, 20, 1.0
#: Slots of the hashed table of suffix statistics, and the weight of the overall rate in a slot's.
SLOTS, PRIOR = 4096, 20.0
#: A url that the trees learn from gets suffix rates of the other folds' urls, so that its own label isn't among its features.
FOLDS = 4


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path). Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: then up to ? # or the end. Null or no ://: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as host + path, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # later ones, the longer, win
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Numeric features of the text of a url; null counts as empty."""
    url = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    count = lambda x, pattern: F.regexp_count(x, F.lit(pattern)).cast("double")
    share = lambda c: (n - F.length(F.replace(url, c, F.lit("")))) / n
    letters = F.array_distinct(F.split(url, ""))
    entropy = F.aggregate(letters, F.lit(0.0), lambda a, c: a - F.when((c != "") & (share(c) > 0), share(c) * F.log2(share(c))).otherwise(F.lit(0.0)))
    return {
        "length": F.length(url).cast("double"),
        "host_length": F.length(host).cast("double"),
        "depth": count(path, r"/+[^/]"),
        "digits": count(url, r"[0-9]") / n,
        "entropy": entropy,
        "parameters": count(url, r"[?&][^=&#?]+="),
        "hyphens": count(host, "-"),
        "labels": count(host, r"[^.]+"),
        "signs": count(url, r"[^A-Za-z0-9]"),
        "fragment": count(url, "#"),
        "secure": F.startswith(url, F.lit("https://")).cast("double"),
    }


SUFFIXES = {"tld": 1, "domain": 2, "host3": 3}


def suffix(host: Column, labels: int) -> Column:
    """The last labels of a host."""
    return F.substring_index(host, ".", -labels)


def slot(host: Column, labels: int, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(suffix(host, labels), F.lit(labels)), F.lit(slots)).cast("int")


@dataclass(frozen=True)
class Model:
    """base log-odds, trees (nested tuples: leaf value, or feature, cut, left, right), block rates per suffix slot and overall."""

    base: float
    trees: list
    rates: dict[tuple[str, int], float]
    overall: float

    def features(self, spark: SparkSession, rows: DataFrame) -> DataFrame:
        """rows (__url, host, path, ...) + a column f_<name> per feature."""
        return with_features(spark, rows, {(k, s, 0): r for (k, s), r in self.rates.items()}, self.overall, F.lit(0))

    def log_odds(self) -> Column:
        total = F.lit(self.base)
        for tree in self.trees:
            total = total + _as_case(tree)
        return total


def with_features(spark: SparkSession, rows: DataFrame, rates: dict[tuple[str, int, int], float], overall: float, fold: Column) -> DataFrame:
    """rows (__url, host, path, ...) + a column f_<name> per feature, with the suffix rates of each row's fold: at most FOLDS x SLOTS rows a suffix."""
    rows = rows.withColumns({f"f_{k}": v for k, v in lexical(F.col("__url"), F.col("host"), F.col("path")).items()} | {"__fold": fold})
    for name, labels in SUFFIXES.items():
        own = sorted((s, f, r) for (k, s, f), r in rates.items() if k == name)
        table = spark.createDataFrame(own or [(-1, 0, 0.0)], f"__slot int, __fold int, f_{name} double")
        rows = rows.withColumn("__slot", slot(F.col("host"), labels)).join(F.broadcast(table), ["__slot", "__fold"], "left").drop("__slot").fillna(overall, [f"f_{name}"])
    return rows.drop("__fold")


def fold_of(url: Column) -> Column:
    return F.pmod(F.xxhash64(url, F.lit("fold")), F.lit(FOLDS)).cast("int")


FEATURES = ["length", "host_length", "depth", "digits", "entropy", "parameters", "hyphens", "labels", "signs", "fragment", "secure", *SUFFIXES]


def _as_case(tree) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    name, cut, left, right = tree
    return F.when(F.col(f"f_{name}") <= cut, _as_case(left)).otherwise(_as_case(right))


def _grow(rows: DataFrame, cuts: dict[str, list[float]], score: Column):
    """One tree for rows with y, weight n and score: each level is one aggregation into (node, feature, bin) sums, at most 2^DEPTH x features x bins rows."""
    p = 1 / (1 + F.exp(-score))
    graded = rows.select(*[f"b_{k}" for k in cuts], (F.col("n") * (F.col("y") - p)).alias("g"), (F.col("n") * p * (1 - p)).alias("h"))
    tree: dict[int, tuple] = {1: ()}
    splits: dict[int, tuple[str, int]] = {}
    for level in range(DEPTH + 1):
        node = F.lit(1)
        for _ in range(level):
            node = _descend(node, splits)
        bins = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"b_{k}").alias("b")) for i, k in enumerate(cuts)])).alias("x")
        sums = graded.select(node.alias("node"), bins, "g", "h").groupBy("node", "x.f", "x.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count(F.lit(1)).alias("n")).collect()
        held: dict[int, dict[int, dict[int, tuple]]] = {}
        for r in sums:
            held.setdefault(r["node"], {}).setdefault(r["f"], {})[r["b"]] = (r["g"], r["h"], r["n"])
        for k in [k for k in tree if k.bit_length() == level + 1]:
            by = held.get(k, {})
            G, H, N = (sum(v[i] for v in by.get(0, {}).values()) for i in range(3))
            tree[k] = (RATE * G / (H + RIDGE),)
            best = (1e-6, None)
            for f, name in enumerate(cuts) if level < DEPTH else ():
                g = h = n = 0.0
                for b in range(len(cuts[name])):
                    x = by.get(f, {}).get(b, (0.0, 0.0, 0))
                    g, h, n = g + x[0], h + x[1], n + x[2]
                    gain = g * g / (h + RIDGE) + (G - g) ** 2 / (H - h + RIDGE) - G * G / (H + RIDGE)
                    if min(n, N - n) >= LEAST and gain > best[0]:
                        best = (gain, (name, b))
            if best[1]:
                splits[k] = best[1]
                tree |= {2 * k: (), 2 * k + 1: ()}
        if not any(k.bit_length() == level + 1 for k in splits):
            break

    def built(k: int):
        if k not in splits:
            return float(round(tree[k][0], 9))
        name, b = splits[k]
        return (name, cuts[name][b], built(2 * k), built(2 * k + 1))

    return built(1)


def _descend(node: Column, splits: dict[int, tuple[str, int]]) -> Column:
    out = node
    for k, (name, b) in splits.items():
        out = F.when(node == k, F.when(F.col(f"b_{name}") <= b, F.lit(2 * k)).otherwise(F.lit(2 * k + 1))).otherwise(out)
    return out


def train(labelled: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Fit on rows (__url, host, path, y: 1 block, 0 allow). Without both labels: the overall rate alone."""
    spark = labelled.sparkSession
    found = labelled.select("y", "__url", fold_of(F.col("__url")).alias("fold"), F.explode(F.array(*[F.struct(F.lit(k).alias("k"), slot(F.col("host"), n).alias("s")) for k, n in SUFFIXES.items()])).alias("x"))
    sums = found.groupBy("x.k", "x.s", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("b")).collect()  # at most 3 x SLOTS x FOLDS rows
    n, b = sum(r["n"] for r in sums if r["k"] == "tld"), sum(r["b"] for r in sums if r["k"] == "tld")
    overall = b / n if n else 0.0
    whole: dict[tuple[str, int], list[int]] = {}
    for r in sums:
        of = whole.setdefault((r["k"], r["s"]), [0, 0])
        of[0], of[1] = of[0] + r["n"], of[1] + r["b"]
    smooth = lambda count, blocked: (blocked + PRIOR * overall) / (count + PRIOR)
    rates = {k: smooth(*v) for k, v in whole.items()}
    apart = {(*k, f): smooth(*v) for k, v in whole.items() for f in range(FOLDS)}
    apart |= {(r["k"], r["s"], r["fold"]): smooth(whole[r["k"], r["s"]][0] - r["n"], whole[r["k"], r["s"]][1] - r["b"]) for r in sums}
    base = math.log((b + 1) / (n - b + 1))
    model = Model(base, [], rates, overall)
    if not 0 < b < n:
        return model
    different = labelled.agg(F.approx_count_distinct("__url").alias("n")).head()["n"]
    keep = max(1, math.ceil(different / max_train))
    sample = labelled.where(F.pmod(F.xxhash64("__url"), F.lit(keep)) == 0).groupBy("__url", "host", "path", "y").agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows = stash(with_features(spark, sample, apart, overall, fold_of(F.col("__url"))).select("y", "n", *[f"f_{k}" for k in FEATURES]), "url-sample")
    at = [i / BINS for i in range(1, BINS)]
    ends = rows.agg(*[F.percentile_approx(f"f_{k}", at).alias(k) for k in FEATURES]).head()
    cuts = {k: sorted(set(ends[k] or [])) or [0.0] for k in FEATURES}
    binned = rows.select("*", *[sum(((F.col(f"f_{k}") > c).cast("int") for c in cuts[k]), F.lit(0)).alias(f"b_{k}") for k in FEATURES])
    binned = stash(binned.coalesce(4), "url-bins")  # about MAX_TRAIN rows at most
    trees: list = []
    for _ in range(TREES):
        trees.append(_grow(binned, cuts, Model(base, trees, rates, overall).log_odds()))
    return Model(base, trees, rates, overall)


def judge(pages: DataFrame, rules=RULES, max_train: int = MAX_TRAIN) -> DataFrame:
    """pages' columns + host, path, rule (null if none fits), verdict, block_score (the trees' probability).

    Every url gets a verdict; null or malformed urls have empty host and path and go by the
    trees like any other. Repeated rows are judged alike. Columns of those names are replaced.
    """
    host, path = parts(F.col("url"))
    own = ("host", "path", "rule", "verdict", "block_score")
    split = pages.select(*[c for c in pages.columns if c not in own], F.col("url").alias("__url"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = split.withColumns({"rule": rule, "__ruled": verdict})
    labelled = ruled.where("__ruled is not null").select("__url", "host", "path", (F.col("__ruled") == "block").cast("int").alias("y"))
    model = train(labelled, max_train)
    scored = model.features(pages.sparkSession, ruled).withColumn("block_score", 1 / (1 + F.exp(-model.log_odds())))
    final = F.coalesce("__ruled", F.when(F.col("block_score") >= 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return scored.withColumn("verdict", final).drop("__url", "__ruled", *[f"f_{k}" for k in FEATURES])
