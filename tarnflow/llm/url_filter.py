"""URL filters: rules by host and path, and for the rest gradient-boosted trees on lexical features.

Features, rules and scoring are Spark expressions. The trees are fitted on the driver from a bounded sample
of labelled URLs and become CASE expressions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, rule) of the query; a rule is a host, and after its first slash the start of a path.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Labelled URLs that training reads at most.
TRAIN_ROWS = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, else nulls; a rule fits its host and all subdomains."""
    rule, verdict = None, None
    for v, r in sorted(rules, key=lambda x: -len(x[1])):
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        rule = F.when(fits, r) if rule is None else rule.when(fits, r)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Lexical features, all doubles without nulls."""
    u = F.coalesce(url, F.lit(""))
    n = F.length(u)
    count = lambda c, x: (F.length(c) - F.length(F.replace(c, F.lit(x)))).cast("double")
    digits = F.length(F.regexp_replace(u, "[^0-9]", ""))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    share = lambda ch: (n - F.length(F.replace(u, ch))) / n
    entropy = F.aggregate(F.array_distinct(F.split(u, "")), F.lit(0.0), lambda s, ch: s - F.when(ch == "", 0.0).otherwise(share(ch) * F.log2(share(ch))))
    suffix = F.substring_index(host, ".", -1)
    return {
        "length": n.cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": count(path, "/"),
        "digit_ratio": F.when(n > 0, digits / n).otherwise(0.0),
        "entropy": F.when(n > 0, entropy).otherwise(0.0),
        "parameters": F.when(query == "", 0.0).otherwise(count(query, "&") + 1),
        "hyphens": count(u, "-"),
        "labels": count(host, "."),
        "suffix_length": F.length(suffix).cast("double"),
        "secure": F.when(u.startswith("https:"), 1.0).otherwise(0.0),
        "fragment": F.when(u.contains("#"), 1.0).otherwise(0.0),
    }


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def _bins(x: np.ndarray, n: int = 16) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, n + 1)[1:-1]))


class BoostedTrees:
    """Gradient boosting of depth-limited regression trees with logistic loss and Newton leaves, in numpy."""

    def __init__(self, trees: int = 30, depth: int = 3, rate: float = 0.3, least: float = 1.0, smooth: float = 1.0):
        self.n, self.depth, self.rate, self.least, self.smooth = trees, depth, rate, least, smooth
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        if not len(y):
            return self
        p = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(p / (1 - p)))
        cuts = [_bins(x[:, k]) for k in range(x.shape[1])]
        codes = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], 1)
        f = np.full(len(y), self.base)
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-f))
            tree, step = self._grow(codes, cuts, p - y, p * (1 - p), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            f += step
        return self

    def _grow(self, codes, cuts, g, h, rows, depth):
        out = np.zeros(len(g))
        G, H = g[rows].sum(), h[rows].sum()
        best = (1e-6, None, None)
        if depth:
            for k, c in enumerate(cuts):
                if not len(c):
                    continue
                b = codes[rows, k]
                gs, hs = (np.cumsum(np.bincount(b, w[rows], len(c) + 1))[:-1] for w in (g, h))
                ok = (hs > self.least) & (H - hs > self.least)
                gain = np.where(ok, gs**2 / (hs + self.smooth) + (G - gs) ** 2 / (H - hs + self.smooth) - G**2 / (H + self.smooth), 0)
                if (j := int(gain.argmax())) is not None and gain[j] > best[0]:
                    best = (gain[j], k, j)
        if best[1] is None:
            value = float(-self.rate * G / (H + self.smooth))
            out[rows] = value
            return value, out
        _, k, j = best
        left = codes[rows, k] <= j
        a, sa = self._grow(codes, cuts, g, h, rows[left], depth - 1)
        b, sb = self._grow(codes, cuts, g, h, rows[~left], depth - 1)
        return (k, float(cuts[k][j]), a, b), sa + sb

    def predict(self, x: np.ndarray) -> np.ndarray:
        def go(tree, row):
            while isinstance(tree, tuple):
                k, cut, a, b = tree
                tree = a if row[k] <= cut else b
            return tree

        return np.array([1 / (1 + np.exp(-self.base - sum(go(t, r) for t in self.trees))) for r in x])

    def expression(self, columns: list[Column]) -> Column:
        """The same score as a Spark expression."""

        def of(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(tree)
            k, cut, a, b = tree
            return F.when(columns[k] <= cut, of(a)).otherwise(of(b))

        total = F.lit(self.base)
        for t in self.trees:
            total = total + of(t)
        return 1 / (1 + F.exp(-total))


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, labelled: DataFrame | None = None, train_rows: int = TRAIN_ROWS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """`(page_id, host, path, rule, verdict, score)` for every row of `pages`.

    A fitting rule decides. Without one the trees do: block at a score of 0.5 or more. They are trained from
    `labelled(url, blocked)`, by default the URLs of `pages` that a rule labels. Training reads
    at most `train_rows` of them (those of least hash of the URL; distinct URLs), so the driver's share is
    bounded; suffix statistics are the smoothed share of blocked URLs and the log count of each
    top-level suffix in that sample. Without any labelled URL the score is 0.5 everywhere.

    Null URLs, or those without `://`, have empty host and path and fit no rule. Repeated rows are judged
    repeatedly. Nothing is shuffled but the sample.
    """
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    own = own.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    own = own.withColumn("rule", rule).withColumn("by_rule", verdict)
    if labelled is None:
        known = own.where(F.col("by_rule").isNotNull()).select("url", (F.col("by_rule") == "block").cast("int").alias("blocked"))
    else:
        known = labelled.select("url", F.col("blocked").cast("int").alias("blocked"))
    sample = known.where("url is not null and blocked is not null").distinct().orderBy(F.xxhash64("url"), "url", "blocked").limit(train_rows)
    cols = features(F.col("url"), host_of(F.col("url")), path_of(F.col("url")))
    rows = sample.select("blocked", suffix_of(host_of(F.col("url"))).alias("suffix"), *[c.alias(k) for k, c in cols.items()]).collect()
    y = np.array([r[0] for r in rows], dtype=float)
    counts: dict[str, list[float]] = {}
    for r in rows:
        at = counts.setdefault(r[1], [0.0, 0.0])
        at[0] += 1
        at[1] += r[0]
    # the sample bounds the number of suffixes
    stats = {s: (float(np.log1p(n)), (b + 1) / (n + 2)) for s, (n, b) in counts.items()}
    x = np.array([[*r[2:], *stats.get(r[1], (0.0, 0.5))] for r in rows], dtype=float).reshape(len(rows), len(cols) + 2)
    model = BoostedTrees().fit(x, y)
    names = [*cols, "suffix_count", "suffix_blocked"]
    table = pages.sparkSession.createDataFrame([(k, *v) for k, v in stats.items()], "s_suffix string, s_count double, s_blocked double")
    known = own.withColumn("f_suffix", suffix_of(F.col("host"))).join(F.broadcast(table), F.col("f_suffix").eqNullSafe(F.col("s_suffix")), "left")
    scored = known.select(*own.columns, *[c.alias(f"f_{k}") for k, c in features(F.col("url"), F.col("host"), F.col("path")).items()], F.coalesce("s_count", F.lit(0.0)).alias("f_suffix_count"), F.coalesce("s_blocked", F.lit(0.5)).alias("f_suffix_blocked"))
    scored = scored.withColumn("score", model.expression([F.col(f"f_{n}") for n in names]))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
