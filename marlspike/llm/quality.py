"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted small trees are fitted to labelled rows; each path from a root to a node is
a conjunction of thresholds.  A lasso logistic regression over those rules (and a
bias) keeps few of them, and the kept rules are compiled into one Spark column, so
scoring is a projection over built-in functions.

Learning takes at most ``MAX_LABELLED`` labelled rows, those with the least hash of
their id; only their statistics reach the driver.

Defined results: null texts are empty; an empty text has all statistics 0 and is
scored like any other; equal texts have equal scores; with one kind of label only,
every text gets the smoothed share of label 1; rows without an id or label are not
learned from; extra columns are ignored.

Scale: one scan, no shuffle; the statistics are linear in a text's length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LABELLED = 20_000
HELD_OUT = (4, 2)
TREES = 40
DEPTH = 3
BINS = 48
LEAF = 8
STRENGTHS = (0.02, 0.01, 0.005, 0.0025)
FOLDS = 4


#: What is counted in a text, and whether it is counted for each character or each word.
COUNTED = {
    "digits": ("[0-9]", "n"),
    "stops": (r"[.!?…]", "count"),
    "commas": (",", "count"),
    "marks": (r"[#$%&*|<>{}\[\]=_@^~\\/]", "count"),
    "exclaims": ("!", "count"),
    "lines": ("\n", "count"),
}
STATISTICS = ["log_words", "word_length", "distinct_words", "upper", *COUNTED]


def measured(rows: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and the statistics of a text column; no language, source or id among them.

    Plain columns in steps, each of which Catalyst computes once: inside a struct, or
    in one step, shared parts would be computed again for every use.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = rows.select(*keep, text.alias("_s_text"))
    rows = rows.select(*keep, "_s_text", F.filter(F.split("_s_text", r"\s+"), lambda w: w != "").alias("_s_words"))
    rows = rows.select(
        *keep, F.length("_s_text").alias("_s_n"), F.size("_s_words").alias("_s_count"), F.size(F.array_distinct("_s_words")).alias("_s_distinct"),
        F.length(F.regexp_replace("_s_text", r"[^\p{Lu}]+", "")).alias("_s_upper"), *[F.regexp_count("_s_text", F.lit(p)).alias(f"_s_{k}") for k, (p, _) in COUNTED.items()],
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(f"_s_{a}").cast("double"), F.col(f"_s_{b}")), F.lit(0.0))
    return rows.select(
        *keep, F.log1p(F.col("_s_count").cast("double")).alias("log_words"), share("n", "count").alias("word_length"), share("distinct", "count").alias("distinct_words"),
        share("upper", "n").alias("upper"), *[share(k, by).alias(k) for k, (_, by) in COUNTED.items()],
    )


class Tree:
    """A regression tree over binned features, grown on gradients; nodes are lists of (feature, bin, above)."""

    def __init__(self, binned: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int, leaf: int):
        self.rules: list[tuple[tuple[int, int, bool], ...]] = []
        self.fit = np.zeros(len(gradient))
        self._grow(binned, gradient, hessian, np.arange(len(gradient)), (), depth, leaf)

    def _grow(self, x, g, h, rows, path, depth, leaf):
        if path:
            self.rules.append(path)
        best = (1e-6, None)
        if depth and len(rows) >= 2 * leaf:
            whole = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
            for f in range(x.shape[1]):
                n, gs, hs = (np.cumsum(np.bincount(x[rows, f], w, BINS))[:-1] for w in (None, g[rows], h[rows]))
                ok = (n >= leaf) & (len(rows) - n >= leaf)
                if ok.any():
                    gain = gs**2 / (hs + 1.0) + (g[rows].sum() - gs) ** 2 / (h[rows].sum() - hs + 1.0) - whole
                    k = int(np.argmax(np.where(ok, gain, -1)))
                    if ok[k] and gain[k] > best[0]:
                        best = (gain[k], (f, k))
        if best[1] is None:
            self.fit[rows] = -g[rows].sum() / (h[rows].sum() + 1.0)
            return
        f, k = best[1]
        above = x[rows, f] > k
        self._grow(x, g, h, rows[~above], (*path, (f, k, False)), depth - 1, leaf)
        self._grow(x, g, h, rows[above], (*path, (f, k, True)), depth - 1, leaf)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, rate: float = 0.3) -> list[tuple[tuple[int, float, bool], ...]]:
    """Distinct conjunctions (feature, threshold, above) from all paths of boosted trees."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
    z = np.full(len(y), np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    rules: dict[tuple, None] = {}
    for _ in range(trees):
        p = sigmoid(z)
        tree = Tree(binned, p - y, p * (1 - p), DEPTH, LEAF)
        z = z + rate * tree.fit
        for path in tree.rules:
            bounds: dict[tuple[int, bool], float] = {}
            for f, k, above in path:
                v = float(cuts[f][min(k, len(cuts[f]) - 1)])
                key = (f, above)
                bounds[key] = max(bounds.get(key, -np.inf), v) if above else min(bounds.get(key, np.inf), v)
            rules[tuple(sorted((f, v, above) for (f, above), v in bounds.items()))] = None
    return list(rules)


def holds(rules, x: np.ndarray) -> np.ndarray:
    """Which rows satisfy which rules, as 0 or 1."""
    out = np.ones((len(x), len(rules)))
    for j, rule in enumerate(rules):
        for f, v, above in rule:
            out[:, j] *= (x[:, f] > v) if above else (x[:, f] <= v)
    return out


def lasso(r: np.ndarray, y: np.ndarray, strength: float, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Logistic weights with an L1 penalty, by accelerated proximal gradient steps; the bias is free."""
    n, m = r.shape
    x = np.column_stack([r, np.ones(n)])
    step = 4 * n / (np.linalg.norm(x, 2) ** 2 + 1e-9)
    w = np.zeros(m + 1)
    w[-1] = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    v, t = w.copy(), 1.0
    for _ in range(rounds):
        new = v - step * (x.T @ (sigmoid(x @ v) - y)) / n
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * strength, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t2 * (new - w)
        if np.abs(new - w).max() < 1e-7:
            w = new
            break
        w, t = new, t2
    return w[:-1], float(w[-1])


class Model:
    """Weighted rules over named statistics and a bias."""

    def __init__(self, names: list[str], rules, weights, bias: float):
        kept = [(r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-9]
        self.names, self.rules, self.bias = names, kept, bias

    def column(self, stats: dict[str, Column]) -> Column:
        """The score as a Spark column over statistics columns."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            test = F.lit(True)
            for f, v, above in rule:
                c = stats[self.names[f]]
                test = test & ((c > F.lit(v)) if above else (c <= F.lit(v)))
            total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.bias + holds([r for r, _ in self.rules], x) @ np.array([w for _, w in self.rules]) if self.rules else np.full(len(x), self.bias))


def train(x: np.ndarray, y: np.ndarray, names: list[str]) -> Model:
    """Rules from trees, weights by lasso; the penalty with the least log loss in seeded folds wins."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Model(names, [], [], float(np.log(share / (1 - share))))
    rules = grow_rules(x, y)
    r = holds(rules, x)
    fold = np.random.default_rng(7).integers(0, FOLDS, len(y))
    loss = []
    for s in STRENGTHS:
        total = 0.0
        for k in range(FOLDS):
            a, b = fold != k, fold == k
            if b.any() and y[a].min() < y[a].max():
                w, bias = lasso(r[a], y[a], s, 200)
                p = np.clip(sigmoid(r[b] @ w + bias), 1e-6, 1 - 1e-6)
                total -= (y[b] * np.log(p) + (1 - y[b]) * np.log(1 - p)).sum()
        loss.append(total)
    return Model(names, rules, *lasso(r, y, STRENGTHS[int(np.argmin(loss))]))


def held_out(id_col: str, fold: tuple[int, int] = HELD_OUT) -> Column:
    """Whether the id's fold is the one that is not learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % fold[0] == fold[1], F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", fold: tuple[int, int] = HELD_OUT, most: int = MAX_LABELLED) -> Model:
    """A model from a bounded sample of labelled rows."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, fold)).groupBy(id_col).agg(F.max(label).alias("_y"))
    known = known.orderBy(F.xxhash64(id_col), id_col).limit(most)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(known), F.col("_id") == known[id_col])
    found = measured(rows, "_text", ["_id", "_y"]).orderBy("_id", *STATISTICS).limit(2 * most).toPandas()
    return train(found[STATISTICS].to_numpy(float).reshape(-1, len(STATISTICS)), found["_y"].to_numpy(float), STATISTICS)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row."""
    rows = measured(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text", ["_id"])
    return rows.select(F.col("_id").alias(id_col), model.column({n: F.col(n) for n in STATISTICS}).alias("score"))


def op5(spark, sf_dir: str) -> DataFrame:
    """``op5_quality`` over all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
