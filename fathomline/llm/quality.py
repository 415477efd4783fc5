"""Quality scores by Bradley-Terry ranking.

A preference pair is a document labelled good and one labelled bad; the chance that the first wins
is the logistic of the difference of their scores. Scores are linear in features of the
whole text, so the loss is a logistic one on feature differences, fitted on a bounded sample of
labelled rows. The raw score of all documents at the quantile of the bad share of all usable labels is mapped to the cut 0.7.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import cut as cut_lineage, held_out

CUT = 0.7
#: Labelled rows that are fitted, the first ones by a hash of their id.
SAMPLE_ROWS = 20_000
#: Preference pairs per labelled row of the rarer label.
PAIRS_EACH = 16
RIDGE = 1e-3
#: Ranges that a pass over the raw scores counts in, to find the quantile.
RANGES = 4096
_ASCII = np.arange(256)
_GROUPS = {
    "upper": (_ASCII >= 65) & (_ASCII <= 90), "lower": (_ASCII >= 97) & (_ASCII <= 122), "digit": (_ASCII >= 48) & (_ASCII <= 57),
    "space": (_ASCII == 32) | (_ASCII == 9), "line": _ASCII == 10, "high": _ASCII >= 128,
    "stop": np.isin(_ASCII, list(b".?;:")), "comma": _ASCII == ord(","), "shout": _ASCII == ord("!"),
    "bar": np.isin(_ASCII, list(b"|/\\<>{}[]=_")), "symbol": np.isin(_ASCII, list(b"#$%&*@^~+")), "quote": np.isin(_ASCII, list(b"\"'()-")),
}
_MASK = np.array(list(_GROUPS.values()), dtype=np.float64)


def features(text: str | None) -> np.ndarray:
    """Shares of characters, words and lines of the whole text; an empty text has zeros."""
    out = np.zeros(FEATURES)
    if not text:
        return out
    raw = text.encode("utf-8", "replace")
    shares = _MASK @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / len(raw)
    words, lines = text.split(), text.split("\n")
    n, distinct = max(1, len(words)), len(set(words))
    k = len(shares)
    out[:k] = np.sqrt(shares)
    out[k : k + 8] = [
        np.log1p(len(words)), np.log1p(len(raw) / n), distinct / n, np.log1p(distinct) / np.log1p(n), len(set(lines)) / len(lines),
        np.log1p(n / len(lines)), sum(w.isupper() for w in words) / n, 1.0,
    ]
    out[k + 8 :] = out[: k + 8] ** 2
    return out


FEATURES = 2 * (len(_GROUPS) + 8)


@dataclass
class Ranking:
    """Weights of the features, the raw score at the quantile, and whether labels of both kinds were seen."""

    weights: np.ndarray
    threshold: float
    cut: float = CUT

    def score(self, x: np.ndarray) -> np.ndarray:
        shift = np.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights - self.threshold + shift, -30, 30)))


def fit_pairs(x: np.ndarray, good: np.ndarray, cut: float = CUT, quantile: float | None = None) -> Ranking | None:
    """Newton steps on the logistic loss of feature differences; None without labels of both kinds."""
    yes, no = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(yes) or not len(no):
        return None
    rng = np.random.default_rng(11)
    n = PAIRS_EACH * max(1, min(len(yes), len(no)))
    scale = x.std(0) + 1e-6
    d = (x[rng.choice(yes, n)] - x[rng.choice(no, n)]) / scale
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # the chance that the preferred one loses
        gradient = d.T @ p / n - RIDGE * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / n + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    raw = x @ (w / scale)
    return Ranking(w / scale, float(np.quantile(raw, (~good).mean() if quantile is None else quantile)), cut)


def _feature_rows(rows: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            values = [features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.float64())), batch.column(2)], names=["good", "x", "id"])

    return rows.mapInArrow(run, "good boolean, x array<double>, id string")


def exact_quantile(rows: DataFrame, name: str, q: float) -> float | None:
    """The quantile of a column of finite doubles, interpolated as numpy does; None without rows.

    Each pass counts in ``RANGES`` ranges and goes on in the one that has the wanted rank, so no rows are ordered or collected.
    """
    n, low, high = rows.agg(F.count(name), F.min(name), F.max(name)).first()
    if not n:
        return None
    at = (n - 1) * min(1.0, max(0.0, q))
    rank = int(at)
    own, value = F.col(name), F.col(name)
    while low < high:
        width = (high - low) / RANGES
        part = F.least(F.floor((value - F.lit(low)) / F.lit(width)), F.lit(RANGES - 1)) if width > 0 else (value > F.lit(low)).cast("long")
        counts = rows.where((own >= F.lit(low)) & (own <= F.lit(high))).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min(own).alias("low"), F.max(own).alias("high"))
        below = rows.where(own < F.lit(low)).count()
        for r in sorted(counts.collect(), key=lambda r: r["part"]):
            if below + r["n"] > rank:
                low, high = r["low"], r["high"]
                break
            below += r["n"]
    if at == rank:
        return low
    upto, after = rows.agg(F.count_if(own <= F.lit(low)), F.min(F.when(own > F.lit(low), own))).first()
    above = low if upto > rank + 1 else after
    return low + (above - low) * (at - rank)


def train(docs: DataFrame, labels: DataFrame, cut: float = CUT, sample_rows: int = SAMPLE_ROWS, quantile: float | None = None) -> Ranking | None:
    """Learns from labels (doc_id, quality 0/1) of documents that are not held out.

    Weights are fitted on at most ``sample_rows`` rows, also where an id has very many: equal rows of an id
    count once, and the first by a hash are taken. The share of bad labels is that of all labels, and its
    quantile is taken over all rows of ``docs``.
    """
    usable = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).select("doc_id", "quality").distinct()
    sample = usable.orderBy(F.xxhash64("doc_id", "quality"), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select((F.col("quality") == 1).alias("good"), F.col("text").cast("string").alias("text"), F.col("doc_id").cast("string").alias("id"))
    chosen = _feature_rows(rows).distinct().orderBy(F.xxhash64("id", "good", "x"), "id").limit(sample_rows)
    found = chosen.select("good", "x").toArrow().to_pandas()
    if not len(found):
        return None
    found = found.assign(key=found["x"].map(lambda v: tuple(v))).sort_values(["key", "good"])  # the same whatever order rows come in
    ranking = fit_pairs(np.stack(found["x"].to_list()), found["good"].to_numpy(dtype=bool), cut, quantile)
    if ranking is None:
        return None
    share = usable.agg(F.avg((F.col("quality") == 0).cast("double"))).first()[0] if quantile is None else quantile
    raw = cut_lineage(docs.select(_scores(lambda x: x @ ranking.weights)(F.col("text").cast("string")).alias("raw")))
    return replace(ranking, threshold=exact_quantile(raw, "raw", share))


def _scores(score):
    @F.pandas_udf("double")
    def run(text: pd.Series) -> pd.Series:
        return pd.Series(score(np.stack([features(t) for t in text]) if len(text) else np.zeros((0, FEATURES))))

    return run


def scored(docs: DataFrame, ranking: Ranking | None, name: str = "score") -> DataFrame:
    """Adds ``name`` (0 to 1, above the cut: good) to the rows of ``docs``; all columns stay.

    Null texts score as empty ones. Without a ranking every score is 0.5.
    """
    score = _scores(lambda x: np.full(len(x), 0.5) if ranking is None else ranking.score(x))
    return docs.withColumn(name, score(F.col("text").cast("string")))


def judge(docs: DataFrame, labels: DataFrame, cut: float = CUT, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text); other columns are not read.

    Empty and null texts get a score too; repeated rows are all returned; labels of null ids, null or
    other values are not learned from.
    """
    ranking = train(docs, labels, cut, sample_rows)
    return scored(docs.select("doc_id", "text"), ranking).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted")
    )
