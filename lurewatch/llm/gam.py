"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into bins by quantiles.  Boosting goes round the features
in turn: each step fits a tree of a few leaves to the current gradients over
one feature's bins and adds it, shrunk, to that feature's look-up table; then
the pairs of features that explain most of what is left get tables of their
own in the same way.  A score is the sum of one table entry for each feature
and pair: vectorised additions.

The model is fitted on at most ``SAMPLE`` labelled rows (chosen by a hash
of the id), a fixed bound; features and scores cover every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.llm.sampling import bounded_sample
from lurewatch.llm.scratch import Scratch

SAMPLE, BINS, ROUNDS, PAIRS, PAIR_ROUNDS, RATE, LEAVES, RIDGE = 20_000, 32, 60, 6, 40, 0.15, 4, 1.0
PREDICT_FROM = 0.3
#: Frequent function words of the corpus's languages (fixed values).
FUNCTION_WORDS = frozenset("the of and to in a is that for de la le les et des que el en los un une der die und das von den mit ist zu".split())
FEATURES = ["words", "word_length", "capitals", "digits", "symbols", "bars", "marks", "stops", "beyond_ascii", "distinct_words",
            "distinct_windows", "distinct_lines", "function_words", "line_words", "short_lines", "longest_word"]


def features(text: str | None) -> list[float]:
    """Measures of a whole text; all zero without words."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8), minlength=256)
    upper, lower = raw[65:91].sum(), raw[97:123].sum()
    count = lambda s: raw[np.frombuffer(s, dtype=np.uint8)].sum()
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    windows = max(1, n - 2)
    return [
        np.log1p(n), sum(map(len, words)) / n, upper / max(1, upper + lower), raw[48:58].sum() / n, count(b"#*$%&<>~^=@{}[]") / n, count(b"|") / n,
        count(b"!?") / n, count(b".,;:") / n, raw[128:].sum() / raw.sum(), len(set(words)) / n,
        len(set(zip(words, words[1:], words[2:]))) / windows if n > 2 else 1.0, len(set(lines)) / max(1, len(lines)),
        sum(w.lower() in FUNCTION_WORDS for w in words) / n, n / max(1, len(lines)), sum(len(x) < 20 for x in lines) / max(1, len(lines)), np.log1p(max(map(len, words))),
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([features(t.as_py()) for t in batch.column(1)], dtype=np.float64).reshape(-1, len(FEATURES))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, i]) for i in range(len(FEATURES)))], names=["doc_id", *FEATURES])


@dataclass
class Model:
    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.edges)], axis=1) if self.edges else np.zeros((len(x), 0), int)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for i, table in enumerate(self.tables):
            out += table[bins[:, i]]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            out += table[bins[:, i], bins[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(self.bins(x)), -35, 35)))


def _gain(g, h):
    return g * g / (h + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values by bin of a tree of at most ``LEAVES`` leaves, grown by the best cut."""
    leaves = [(0, len(g))]
    sums_g, sums_h = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])

    def best(a, b):
        cuts = np.arange(a + 1, b)
        if not len(cuts):
            return 0.0, None
        lg, lh, ag, ah = sums_g[cuts] - sums_g[a], sums_h[cuts] - sums_h[a], sums_g[b] - sums_g[a], sums_h[b] - sums_h[a]
        gains = _gain(lg, lh) + _gain(ag - lg, ah - lh) - _gain(ag, ah)
        at = int(np.argmax(gains))
        return float(gains[at]), int(cuts[at])

    while len(leaves) < LEAVES:
        gain, cut, leaf = max(((*best(*x), x) for x in leaves), key=lambda c: c[0])
        if cut is None or gain <= 1e-9:
            break
        leaves.remove(leaf)
        leaves += [(leaf[0], cut), (cut, leaf[1])]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = (sums_g[b] - sums_g[a]) / (sums_h[b] - sums_h[a] + RIDGE)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, tuple[int, int]]:
    """Best pair of cuts of a two-way table, and its gain over no cut."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    total = _gain(cg[-1, -1], ch[-1, -1])
    a, b = cg[:-1, :-1], ch[:-1, :-1]
    right_g, right_h = cg[:-1, -1:] - a, ch[:-1, -1:] - b
    below_g, below_h = cg[-1:, :-1] - a, ch[-1:, :-1] - b
    rest_g, rest_h = cg[-1, -1] - a - right_g - below_g, ch[-1, -1] - b - right_h - below_h
    gains = _gain(a, b) + _gain(right_g, right_h) + _gain(below_g, below_h) + _gain(rest_g, rest_h) - total
    at = np.unravel_index(int(np.argmax(gains)), gains.shape)
    return float(gains[at]), (int(at[0]) + 1, int(at[1]) + 1)


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Model of 0/1 labels.  Without rows every score is one half; with one class only, near that class."""
    model = Model()
    if not len(x):
        return model
    rate = (y.sum() + 1) / (len(y) + 2)
    model.base = float(np.log(rate / (1 - rate)))
    model.edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) for i in range(x.shape[1])]
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(s) for s in sizes]
    bins = model.bins(x)
    margin = np.full(len(y), model.base)

    def gradients():
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for i, size in enumerate(sizes):
            g, h = gradients()
            step = RATE * _tree(np.bincount(bins[:, i], g, size), np.bincount(bins[:, i], h, size))
            model.tables[i] += step
            margin += step[bins[:, i]]

    def table(i, j, values):
        return np.bincount(bins[:, i] * sizes[j] + bins[:, j], values, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])

    g, h = gradients()
    ranked = sorted(((-_quadrants(table(i, j, g), table(i, j, h))[0], (i, j)) for i, j in combinations(range(len(sizes)), 2) if min(sizes[i], sizes[j]) > 1))
    model.pairs = [p for _, p in ranked[:PAIRS]]
    model.pair_tables = [np.zeros((sizes[i], sizes[j])) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for values, (i, j) in zip(model.pair_tables, model.pairs):
            g, h = gradients()
            tg, th = table(i, j, g), table(i, j, h)
            _, (a, b) = _quadrants(tg, th)
            step = np.zeros_like(values)
            for rows, cols in ((slice(None, a), slice(None, b)), (slice(None, a), slice(b, None)), (slice(a, None), slice(None, b)), (slice(a, None), slice(b, None))):
                step[rows, cols] = RATE * tg[rows, cols].sum() / (th[rows, cols].sum() + RIDGE)
            values += step
            margin += step[bins[:, i], bins[:, j]]
    return model


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs`` (doc_id, text); other columns are ignored.

    Only labelled rows that are not held out teach the model: those whose
    crc32 of the id as text isn't divisible by five.  Rows without an id are
    scored and not held out.  Null and empty texts have zero features and get
    their score like all others.  Null labels teach nothing; without labels
    every score is one half.  Repeated rows are scored each, and alike.
    """
    scratch = Scratch(docs.sparkSession, "gam")
    kinds = "doc_id long, " + ", ".join(f"`{f}` double" for f in FEATURES)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    measured = scratch.write(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_measure, kinds))
    known = labels.filter(F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("double").alias("_quality"))
    known = scratch.write(measured.filter(~held_out).join(known, "doc_id"))
    taught = bounded_sample(known, ["doc_id", *FEATURES], sample).toPandas().sort_values(["doc_id", *FEATURES], kind="stable")
    model = fit(taught[FEATURES].to_numpy(dtype=np.float64), taught["_quality"].to_numpy(dtype=np.float64))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(f).to_numpy(zero_copy_only=False) for f in FEATURES], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

    return measured.mapInArrow(add, "doc_id long, score double").select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= PREDICT_FROM, 1).otherwise(0).alias("predicted"))


def op1_quality(spark, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from ``labels``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
