"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the rest.

Everything that touches rows is a DataFrame or SQL expression. URLs that a rule judges are the
labelled ones (block is 1). Features: length, path depth, digit ratio, character entropy, numbers
of parameters and host labels, host length, and statistics of host suffixes (smoothed share of
blocked URLs under the last label, and under the last two). A labelled URL's own fold, one of ``folds``
by its hash, is left out of its suffixes' shares, so that no tree learns from a row's own label.

Training is histogram boosting over the whole labelled table: features are cut at quantiles into
``bins`` bins, equal rows collapse with their counts, and each level of each tree is one grouped
sum of gradients by (node, feature, bin), a table whose size is fixed by these numbers. Logistic
loss, second-order leaves, whose sums are known from the split above. The trees become one CASE expression for scoring.

Suffix statistics keep every suffix. The ``suffixes`` most frequent ones are broadcast, so that table is
bounded; rows with rarer ones are joined by key. A suffix without labelled URLs gets the overall
share. Rules are a parameter of at most 1,000.

Defined results: a null URL, or one without ``://``, has empty host and path, fits no rule and is
judged by the trees; of rules of one length the last in order wins; without labelled rows, or with one class only, the trees are a constant
(allow, if there are none); a score of one half is block; a very long URL is read whole; repeated rows are judged each, and
a null id stays null; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.llm.graph import saved

#: (verdict, host and path)
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
FEATURES = ["length", "depth", "digit_ratio", "entropy", "params", "labels", "host_length", "suffix1", "suffix2"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path and query; empty where there is no ://."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)


def rule_for(host: Column, path: Column, rules: list) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict."""
    if len(rules) > 1000:
        raise ValueError("at most 1,000 rules")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        own_host, _, own_path = text.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith("/" + own_path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def lexical(rows: DataFrame) -> DataFrame:
    """Adds the features that need the URL alone, and the suffixes."""
    labels = F.split("host", r"\.")
    size = F.char_length("full")
    entropy = F.expr(
        "aggregate(array_distinct(split(full, '')), 0D, (s, c) -> s - if(c = '', 0D,"
        " (char_length(full) - char_length(replace(full, c, ''))) / char_length(full)"
        " * log2((char_length(full) - char_length(replace(full, c, ''))) / char_length(full))))"
    )
    return rows.select(
        "*",
        size.cast("double").alias("length"),
        F.size(F.array_remove(F.split("path", "/"), "")).cast("double").alias("depth"),
        (F.char_length(F.regexp_replace("full", "[^0-9]", "")) / F.greatest(size, F.lit(1))).alias("digit_ratio"),
        entropy.alias("entropy"),
        F.size(F.array_remove(F.split("query", "&"), "")).cast("double").alias("params"),
        F.size(labels).cast("double").alias("labels"),
        F.char_length("host").cast("double").alias("host_length"),
        F.substring_index("host", ".", -1).alias("tail1"),
        F.substring_index("host", ".", -2).alias("tail2"),
    )


class Tree:
    """A node: a leaf's value, or a split of a feature at a bin with two nodes below."""

    def __init__(self, path: int = 1):
        self.path, self.value, self.sums, self.split, self.below = path, 0.0, (0.0, 0.0), None, ()

    def leaves(self) -> list[Tree]:
        return [self] if self.split is None else [x for b in self.below for x in b.leaves()]

    def sql(self, cut, leaf) -> str:
        """CASE over splits; cut(feature, bin) is the condition of the left side."""
        if self.split is None:
            return leaf(self)
        return f"CASE WHEN {cut(*self.split)} THEN {self.below[0].sql(cut, leaf)} ELSE {self.below[1].sql(cut, leaf)} END"


def boost(rows: DataFrame, trees: int, depth: int, bins: int, rate: float, penalty: float) -> Column:
    """The margin (log-odds of block), as an expression over FEATURES; rows have them and a label."""
    shares = ",".join(f"{k / bins}D" for k in range(1, bins))
    edges = rows.agg(*(F.expr(f"percentile_approx({f}, array({shares}), 10000)").alias(f) for f in FEATURES), F.sum("label").alias("y"), F.count(F.lit(1)).alias("n")).first()
    if not edges["n"]:
        return F.lit(-1.0)
    prior = math.log((edges["y"] + 0.5) / (edges["n"] - edges["y"] + 0.5))
    if edges["y"] in (0, edges["n"]):
        return F.lit(prior)
    cuts = {f: sorted(set(edges[f])) for f in FEATURES}
    binned = rows.select("label", *(F.expr(f"size(filter(array({','.join(f'{e!r}D' for e in cuts[f])}), e -> e < {f}))").alias(f) for f in FEATURES))
    table = saved(binned.groupBy("label", *FEATURES).agg(F.count(F.lit(1)).alias("n")))
    by_bin = lambda f, b: f"{f} <= {b}"
    forest: list[Tree] = []
    for _ in range(trees):
        margin = " + ".join([f"{prior!r}D", *(t.sql(by_bin, lambda x: f"{x.value!r}D") for t in forest)])
        state = table.selectExpr("*", f"1 / (1 + exp(-({margin}))) AS p")
        tree = Tree()
        for level in range(depth):
            node = tree.sql(by_bin, lambda x: str(x.path))
            long = state.selectExpr(f"{node} AS node", "n * (p - label) AS g", "n * p * (1 - p) AS h", f"stack({len(FEATURES)}, {', '.join(f'{i}, {f}' for i, f in enumerate(FEATURES))}) AS (f, b)")
            sums: dict[int, dict[int, list]] = {}
            for r in long.groupBy("node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
                sums.setdefault(r["node"], {}).setdefault(r["f"], []).append((r["b"], r["g"], r["h"]))
            if not level:  # the root's sums are those of any feature's bins
                tree.sums = tuple(sum(x[k] for x in sums[1][0]) for k in (1, 2))
                tree.value = -rate * tree.sums[0] / (tree.sums[1] + penalty)
            grown = False
            for leaf in tree.leaves():
                if leaf.path not in sums or leaf.path >> level != 1:
                    continue
                g, h = leaf.sums
                best = (1e-6, None, 0.0, 0.0)
                for f, got in sorted(sums[leaf.path].items()):
                    gl = hl = 0.0
                    for b, gb, hb in sorted(got)[:-1]:
                        gl, hl = gl + gb, hl + hb
                        gain = gl * gl / (hl + penalty) + (g - gl) ** 2 / (h - hl + penalty) - g * g / (h + penalty)
                        if gain > best[0] + 1e-9:
                            best = (gain, (FEATURES[f], b), gl, hl)
                if best[1]:
                    grown, leaf.split, leaf.below = True, best[1], (Tree(2 * leaf.path), Tree(2 * leaf.path + 1))
                    for side, sums_ in zip(leaf.below, ((best[2], best[3]), (g - best[2], h - best[3])), strict=True):
                        side.sums, side.value = sums_, -rate * sums_[0] / (sums_[1] + penalty)
            if not grown:
                break
        forest.append(tree)
    by_edge = lambda f, b: f"{f} <= {cuts[f][b]!r}D"  # noqa: E731  a bin counts the edges below the value
    return F.expr(" + ".join([f"{prior!r}D", *(t.sql(by_edge, lambda x: f"{x.value!r}D") for t in forest)]))


def with_shares(rows: DataFrame, tail: str, stat: DataFrame, suffixes: int) -> DataFrame:
    """Adds each row's suffix statistics s from stat(t, s, c), null where it has none."""
    hot = saved(stat.orderBy(F.desc("c"), "t").limit(suffixes).select("t", "s"))
    rows = rows.join(F.broadcast(hot), F.col(tail) == F.col("t"), "left").drop("t")
    if stat.count() <= suffixes:
        return rows
    # rows that have theirs are spread over keys of their own
    key = F.when(F.col("s").isNull(), F.concat(F.lit("."), tail)).otherwise(F.xxhash64("full").cast("string"))
    rest = stat.select(F.concat(F.lit("."), F.col("t")).alias("key"), F.col("s").alias("rare"))
    return rows.withColumn("key", key).join(rest, "key", "left").withColumn("s", F.coalesce("s", "rare")).drop("key", "rare")


def judge_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: list = RULES,
    trees: int = 12,
    depth: int = 3,
    bins: int = 16,
    rate: float = 0.4,
    penalty: float = 1.0,
    suffixes: int = 1000,
    folds: int = 5,
    learn: str = "true",
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score (probability of block by the trees).
    learn: a condition on host and path for labelled URLs to learn from."""
    host, path, query = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("full"), host.alias("host"), path.alias("path"), query.alias("query"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("said")).withColumn("label", F.when(~F.expr(learn), None).when(F.col("said") == "block", 1).when(F.col("said") == "allow", 0))
    rows = lexical(rows.withColumn("fold", F.pmod(F.xxhash64("full"), F.lit(folds)).cast("int")))
    known = rows.where("label is not null")
    share = known.agg(F.avg("label")).first()[0]
    share = 0.5 if share is None else float(share)
    for k in ("1", "2"):
        # sums of labels and numbers of rows, by fold; of a labelled row its own fold's are taken off
        parts = [x for i in range(folds) for x in (F.sum(F.when(F.col("fold") == i, F.col("label")).otherwise(0)), F.count_if(F.col("fold") == i))]
        stat = known.groupBy(F.col(f"tail{k}").alias("t")).agg(F.array(*(x.cast("double") for x in parts)).alias("s"), F.count(F.lit(1)).alias("c"))
        rows = with_shares(rows, f"tail{k}", saved(stat), suffixes)
        of = lambda at: " + ".join(f"if(label is null or fold <> {i}, s[{2 * i + at}], 0D)" for i in range(folds))
        rows = rows.withColumn(f"suffix{k}", F.expr(f"if(s is null, {share!r}D, ({of(0)} + 2 * {share!r}D) / ({of(1)} + 2))")).drop("s")
    margin = boost(rows.where("label is not null").select("label", *FEATURES), trees, depth, bins, rate, penalty)
    judged = rows.select("page_id", "host", "path", "rule", "said", (1 / (1 + F.exp(-margin))).alias("score"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
