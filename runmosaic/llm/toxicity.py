"""Toxicity by a counterfactual-regularised classifier over words and their beginnings."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runmosaic.llm.common import part_of, rows, written
from runmosaic.llm.logistic import Rows, fit, sigmoid

# fixed values: group terms, which may stand for one another within a line
GROUPS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "natives"), ("immigrant", "refugee", "native"),
    ("disabled", "blind", "deaf"), ("old", "young"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
SWAP = {t: line[(i + 1) % len(line)] for line in GROUPS for i, t in enumerate(line)}
TOKEN = re.compile(r"[^\W\d_]+")
BEGINNINGS = (3, 4, 5, 6)
SAMPLE = 20_000
FEATURES = 2_000
LEAST_DOCS = 4
LEAST_Z = 4.0
MISSED = 2.0  # a toxic row weighs as much as two clean ones


def tokens(text: str | None) -> set[str]:
    return set(TOKEN.findall((text or "").lower()))


def features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in BEGINNINGS if len(word) >= k)]


def active(words: set[str], number: dict[str, int]) -> list[int]:
    return sorted({number[f] for w in words for f in features(w) if f in number})


def labelled(docs: DataFrame, labels: DataFrame, target: str, keep, sample: int = SAMPLE) -> DataFrame:
    """``text, y`` of at most ``sample`` labelled rows, drawn by a hash of the id; ids must be in ``keep``.

    Only the drawn labels, whose number is bounded by the parameter, are sent to the tasks that read texts.
    """
    ids = labels.filter(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & keep).groupBy("doc_id").agg(F.max(F.col(target)).cast("int").alias("y"))
    drawn = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.join(F.broadcast(drawn), "doc_id")


def feature_counts(sample: DataFrame, held: int = 400_000) -> DataFrame:
    """``feature, n, pos``: documents with the feature, added up in each task in pieces of at most ``held`` entries."""

    def out(n: Counter, pos: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([pos[f] for f in n], pa.int64())], names=["feature", "n", "pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, pos = Counter(), Counter()
        for b in rows(batches):
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = {f for w in tokens(text) for f in features(w)}
                n.update(found)
                if y:
                    pos.update(found)
                if len(n) > held:
                    yield out(n, pos)
                    n, pos = Counter(), Counter()
        yield out(n, pos)

    return sample.select("text", "y").mapInArrow(run, "feature string, n bigint, pos bigint").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))


class Model:
    def __init__(self, number: dict[str, int], weight: np.ndarray, bias: float, known: bool):
        self.number, self.weight, self.bias, self.known = number, weight, bias, known

    def score(self, text: str | None, cache: dict) -> float:
        if not self.known:
            return 0.0
        found: set[int] = set()
        for w in tokens(text):
            a = cache.get(w)
            if a is None:
                if len(cache) > 200_000:
                    cache.clear()
                a = cache[w] = tuple(self.number[f] for f in features(w) if f in self.number)
            found.update(a)
        return float(sigmoid(self.bias + sum(self.weight[i] for i in found)))


def train(sample: DataFrame, features_most: int = FEATURES, penalty: float = 5.0) -> Model:
    """Fits on ``text, y``. Features are chosen over the whole sample by how far their share of toxic documents lies
    from the average, in standard errors (``LEAST_Z`` at least); group terms are always among them. For each labelled text that names a
    group, texts with the term swapped make the pairs whose scores the penalty pulls together. So that terms too
    rare to be seen stay neutral as well, each term alone is paired with the one that stands for it."""
    sample = written(sample.select("text", "y"), "toxic-sample")
    total = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("pos")).first()
    if not 0 < total.pos < total.n:
        return Model({}, np.zeros(0), 0.0, False)
    p = total.pos / total.n
    z = F.abs(F.col("pos") - p * F.col("n")) / F.sqrt(F.col("n") * p * (1 - p))
    chosen = feature_counts(sample).filter((F.col("n") >= LEAST_DOCS) & (z >= LEAST_Z)).orderBy(F.desc(z), "feature").limit(features_most).select("feature").collect()
    names = sorted({r.feature for r in chosen} | {f for t in SWAP for f in features(t)})
    number = {f: i for i, f in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            x, left, right = [], [], []
            for text in b.column(0).to_pylist():
                words = tokens(text)
                x.append(active(words, number))
                one, other = [], []
                for t in sorted(words & SWAP.keys()):
                    one.append(x[-1])
                    other.append(active(words - {t} | {SWAP[t]}, number))
                left.append(one)
                right.append(other)
            many = pa.list_(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.int32())), b.column(1).cast(pa.int32()), pa.array(left, many), pa.array(right, many)], names=["x", "y", "l", "r"])

    got = sample.mapInArrow(run, "x array<int>, y int, l array<array<int>>, r array<array<int>>").toArrow().to_pydict()
    order = sorted(range(len(got["x"])), key=lambda i: (got["x"][i], got["y"][i]))  # sums in one order, whatever the tasks' order
    left = [a for i in order for a in got["l"][i]] + [active({t}, number) for t in SWAP]
    right = [a for i in order for a in got["r"][i]] + [active({SWAP[t]}, number) for t in SWAP]
    y = np.array([got["y"][i] for i in order], float)
    w, b = fit(Rows([got["x"][i] for i in order]), y, len(names), ridge=0.25 / len(y), weight=np.where(y == 1, MISSED, 1.0), swapped=(Rows(left), Rows(right)), penalty=penalty)
    return Model(number, w, b, True)


def score_column(model: Model):
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        cache: dict = {}
        return pd.Series([model.score(t, cache) for t in texts], dtype=float)

    return score


def toxicity_report(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document; only the text enters the score.

    Labels of held-out rows (crc32 of the id as text, mod 5, is 0) are never read. Without labels of both
    classes every score is 0. Null text is scored as empty text; repeated rows score alike.
    """
    used = docs.select("doc_id", "text")
    model = train(labelled(used, labels, "toxic", part_of("doc_id") != 0, sample))
    scored = used.select("doc_id", (part_of("doc_id") == 0).alias("held_out"), score_column(model)("text").alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
