"""Toxicity by cumulative-link ordinal regression over sparse text features.

Features are the distinct words of a text and their first four and five letters (stems survive inflection and made-up endings). Grades
are 0 for texts labelled clean and 1 to 3 for texts labelled toxic, by thirds of the number of their features that are telling in the
labelled sample. One weight vector is shared by all thresholds: P(grade >= k) = sigmoid(w.x - t_k), t_1 <= t_2 <= t_3. The
expected severity is the sum of these; a text is rejected where grade 1 or more is likelier than grade 0.

The model is fitted on at most ``SAMPLE`` labelled rows (smallest hash of the id) and at most ``VOCABULARY`` features (largest chi-square), so
what reaches the driver is bounded by these parameters. Scoring covers every row and its whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import written

SAMPLE, VOCABULARY, GRADES = 8000, 2048, 3
LETTERS = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> tuple[str, ...]:
    return (word, *(f"{word[:n]}*" for n in (4, 5) if len(word) >= n))


def text_features(text: str | None) -> set[str]:
    return {f for w in set(LETTERS.findall((text or "").lower())) for f in features_of(w)}


@dataclass
class SeverityModel:
    weights: dict[str, float]
    thresholds: list[float]

    def reach(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.., one row per score."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - np.array(self.thresholds), -40, 40)))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, width: int, ridge: float = 0.3, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Proportional-odds likelihood with a ridge on the weights, by Adam over all rows. ``rows`` hold feature numbers."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate([*rows, np.zeros(0, int)]).astype(int)
    n, top = len(rows), int(grades.max())
    # Thresholds as a first value and positive steps, so they stay in order.
    x = np.concatenate([np.zeros(width), [2.0], np.zeros(top - 1)])
    first, second = np.zeros_like(x), np.zeros_like(x)
    for turn in range(1, rounds + 1):
        w, cut = x[:width], np.cumsum(np.concatenate([x[width:width + 1], np.log1p(np.exp(x[width + 1:])) + 1e-3]))
        score = np.bincount(owner, w[col], n)
        reach = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(-np.clip(score[:, None] - cut, -40, 40))), np.zeros((n, 1))], 1)
        at = np.arange(n)
        high, low = reach[at, grades], reach[at, grades + 1]
        p = np.maximum(high - low, 1e-9)
        d_high, d_low = high * (1 - high) / p, low * (1 - low) / p
        g_score = -(d_high - d_low)
        g_cut = np.zeros(top)
        np.add.at(g_cut, grades[grades > 0] - 1, d_high[grades > 0])
        np.add.at(g_cut, grades[grades < top], -d_low[grades < top])
        tail = np.cumsum(g_cut[::-1])[::-1]
        slope = 1 / (1 + np.exp(-x[width + 1:]))
        grad = np.concatenate([np.bincount(col, g_score[owner], width) + ridge * w, tail[:1], tail[1:] * slope])
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        x = x - 0.1 * (first / (1 - 0.9 ** turn)) / (np.sqrt(second / (1 - 0.99 ** turn)) + 1e-8)
    return x[:width], np.cumsum(np.concatenate([x[width:width + 1], np.log1p(np.exp(x[width + 1:])) + 1e-3]))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
        sample: int = SAMPLE, vocabulary: int = VOCABULARY) -> SeverityModel | None:
    """The model of a bounded labelled sample, or None where the labels do not hold both classes. Rows without a label are not used."""
    known = labels.where(F.col(f"`{label}`").isin(0, 1)).select(
        F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("toxic")).where("id is not null")
    chosen = known.dropDuplicates(["id"]).orderBy(F.md5(F.col("id").cast("string")), "id").limit(sample)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "toxic": batch["toxic"], "features": [sorted(text_features(t)) for t in batch["text"]]})

    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    # The sample has at most ``sample`` rows of two numbers.
    kind = docs.schema[doc_id].dataType.simpleString()
    held = written(texts.join(F.broadcast(chosen), "id").mapInPandas(run, f"id {kind}, toxic int, features array<string>"), "toxic-sample")
    sizes = {r["toxic"]: r["n"] for r in held.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return None
    n = bad + good
    counts = held.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(
        F.sum("toxic").alias("b"), F.count(F.lit(1)).alias("a"))
    chi = n * F.pow(F.col("b") * n - F.col("a") * bad, 2) / (F.col("a") * (n - F.col("a")) * float(bad) * good)
    best = counts.where((F.col("a") >= max(3, n // 1000)) & (F.col("a") < n)).withColumn("chi", chi).where("chi >= 20").orderBy(
        F.desc("chi"), "f").limit(vocabulary).collect()
    number = {r["f"]: i for i, r in enumerate(best)}
    if not number:
        return None
    telling = {r["f"] for r in best if r["b"] / r["a"] > (1 + bad / n) / 2}

    def to_numbers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "toxic": batch["toxic"],
                                "x": [sorted(number[f] for f in fs if f in number) for fs in batch["features"]],
                                "signs": [sum(f in telling for f in fs) for fs in batch["features"]]})

    rows = held.mapInPandas(to_numbers, f"id {kind}, toxic int, x array<int>, signs bigint").toPandas().sort_values(["id", "signs"], kind="stable")
    toxic, signs = rows["toxic"].values == 1, rows["signs"].values
    cuts = np.quantile(signs[toxic], [i / GRADES for i in range(1, GRADES)])
    grades = np.where(toxic, 1 + (signs[:, None] > cuts).sum(1), 0)
    grades = np.unique(np.concatenate([[0], grades]), return_inverse=True)[1][1:]  # no empty grade between two others
    weights, thresholds = fit_ordinal([np.asarray(x, int) for x in rows["x"]], grades, len(number))
    return SeverityModel({f: float(weights[i]) for f, i in number.items()}, thresholds.tolist())


def score(docs: DataFrame, model: SeverityModel | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``severity`` (expected grade), ``grade`` (the most likely) and ``toxic`` (grade 1 or more likelier than 0).

    Input columns of these names are replaced; other columns and all rows are kept. A null or empty text scores like one without
    features. Without a model every severity is 0 and nothing is toxic.
    """
    keep = [c for c in docs.columns if c not in ("severity", "grade", "toxic")]
    base = docs.select(*[F.col(f"`{c}`") for c in keep])
    if model is None:
        return base.withColumns({"severity": F.lit(0.0), "grade": F.lit(0), "toxic": F.lit(False)})
    weights = model.weights

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple] = {}  # word -> its features in the model; bounded
        for batch in texts:
            sums = []
            for t in batch:
                met: set[str] = set()
                for w in set(LETTERS.findall((t or "").lower())):
                    fs = known.get(w)
                    if fs is None:
                        fs = tuple(f for f in features_of(w) if f in weights)
                        if len(known) > 200_000:
                            known.clear()
                        if len(w) <= 48:
                            known[w] = fs
                    if fs:
                        met.update(fs)
                sums.append(sum(weights[f] for f in sorted(met)))
            reach = model.reach(np.array(sums, float))
            full = np.concatenate([np.ones((len(sums), 1)), reach, np.zeros((len(sums), 1))], 1)
            yield pd.DataFrame({"severity": reach.sum(1), "grade": (full[:, :-1] - full[:, 1:]).argmax(1), "toxic": reach[:, 0] > 0.5})

    udf = F.pandas_udf(run, "severity double, grade int, toxic boolean")
    scored = base.withColumn("__s", udf(F.col(f"`{text}`")))
    return scored.select(*[F.col(f"`{c}`") for c in keep], "__s.severity", "__s.grade", "__s.toxic")
