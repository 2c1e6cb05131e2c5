"""Document quality by co-training: one view sees the text, the other the page's metadata."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runmosaic.llm.common import part_of, whole_row
from runmosaic.llm.logistic import Rows, fit, sigmoid

SAMPLE = 20_000
POOL = 20_000
ROUNDS = 4
CUTS = (0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.85, 0.9, 0.95, 0.98, 0.99)
SOURCES = 200
CONFIDENT = 0.97
PER_ROUND = 1_000
SYMBOLS = re.compile(r"[#$%&*|<>{}~^]")
ENDS = re.compile(r"[.!?…](?:\s|$)")
TEXT_WIDTH = 14


def _text_facts(text: str | None) -> list[float]:
    t = text or ""
    w = t.split()
    k = max(len(w), 1)
    lines = [x for x in t.split("\n") if x.strip()]
    per_line = [x.split() for x in lines]
    m = max(len(lines), 1)
    noisy = [len(SYMBOLS.findall(x)) / max(len(p), 1) for x, p in zip(lines, per_line)]
    loops = [1 - len(set(p)) / len(p) for p in per_line if len(p) >= 5]
    return [
        np.log1p(len(w)), len(t) / k, len(set(w)) / k, sum(a == b for a, b in zip(w, w[1:])) / k, len(set(zip(w, w[1:]))) / k,
        sum(x.isupper() and len(x) > 1 for x in w) / k, len(SYMBOLS.findall(t)) / k, t.count("!!") / k,
        len(ENDS.findall(t)) / k, len(set(lines)) / m, max(Counter(w).values(), default=0) / k, sum(len(p) < 3 for p in per_line) / m,
        max(noisy, default=0.0), max(loops, default=0.0)]


def text_facts(texts) -> np.ndarray:
    """Numbers that describe each whole text: lengths, repetition, case, signs, line ends; no words as such."""
    return np.array([_text_facts(t) for t in texts], float).reshape(-1, TEXT_WIDTH)


class TextView:
    """Each number cut at the sample's quantiles; one weight a bin."""

    def __init__(self, facts: np.ndarray):
        self.edges = [np.unique(np.quantile(facts[:, j], CUTS)) for j in range(facts.shape[1])]
        self.base = np.cumsum([0, *(len(e) + 1 for e in self.edges)])

    def active(self, facts: np.ndarray) -> np.ndarray:
        return np.stack([self.base[j] + np.searchsorted(e, facts[:, j], side="right") for j, e in enumerate(self.edges)], axis=1) if len(facts) else np.zeros((0, len(self.edges)), int)

    @property
    def width(self) -> int:
        return int(self.base[-1])


class MetaView:
    """Language, source and length in characters as the table states them; rare sources share one weight."""

    def __init__(self, meta: pd.DataFrame):
        names = lambda c, most: {v: i + 1 for i, v in enumerate(sorted(meta[c].dropna().astype(str).value_counts().sort_index().sort_values(ascending=False, kind="stable").index[:most]))}
        self.lang, self.source = names("lang", 50), names("source", SOURCES)

    def active(self, meta: pd.DataFrame) -> np.ndarray:
        lang = [self.lang.get(str(v), 0) for v in meta["lang"]]
        source = [self.source.get(str(v), 0) for v in meta["source"]]
        chars = np.clip(np.log2(1 + np.clip(pd.to_numeric(meta["n_chars"], errors="coerce").fillna(0).to_numpy(float), 0, None)), 0, 30).astype(int)
        a = len(self.lang) + 1
        return np.stack([np.array(lang, int), a + np.array(source, int), a + len(self.source) + 1 + chars], axis=1) if len(meta) else np.zeros((0, 3), int)

    @property
    def width(self) -> int:
        return len(self.lang) + len(self.source) + 2 + 31


class Calibrated:
    """A view's classifier and the line that turns its score into a probability, fitted on rows it did not learn from."""

    def __init__(self, view, x: np.ndarray, y: np.ndarray, weight: np.ndarray, hx: np.ndarray, hy: np.ndarray):
        self.view = view
        self.w, self.b = fit(Rows(list(x)), y, view.width, ridge=2 / max(1, len(y)), weight=weight, steps=200)
        self.slope, self.shift = _line(self.raw(hx)[:, None], hy)
        self.slope = self.slope[0]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.w[x].sum(axis=1) + self.b if len(x) else np.zeros(0)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.raw(x) + self.shift


def _line(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[np.ndarray, float]:
    """Logistic regression on a few numbers by Newton's method, with a slight pull to nought."""
    a = np.column_stack([z, np.ones(len(z))])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = sigmoid(a @ w)
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (p - y) + 1e-2 * w)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1], float(w[-1])


class Model:
    def __init__(self, text: Calibrated | None, meta: Calibrated | None, mix: np.ndarray, shift: float):
        self.text, self.meta, self.mix, self.shift = text, meta, mix, shift

    def score(self, facts: np.ndarray, meta: pd.DataFrame) -> np.ndarray:
        if self.text is None:
            return np.ones(len(meta))
        z = np.column_stack([self.text.logit(self.text.view.active(facts)), self.meta.logit(self.meta.view.active(meta))])
        return sigmoid(z @ self.mix + self.shift)


def co_train(facts: np.ndarray, meta: pd.DataFrame, y: np.ndarray, held: np.ndarray, rounds: int = ROUNDS) -> tuple[Model, int]:
    """``y`` is NaN where there is no label; ``held`` marks labelled rows kept for calibration.

    In each round both views learn, are calibrated on the held rows, and label for each other the unlabelled
    rows they are most sure of: those beyond ``CONFIDENT``, at most ``PER_ROUND`` a class, in proportion to
    the classes. A view that separates nothing is never that sure, so it teaches nothing. At the end a
    line over both calibrated views, fitted on the held rows, gives the score. Also returns how many
    pseudo-labels were given.
    """
    known = ~np.isnan(y)
    learn, held = known & ~held, known & held
    if len(set(y[learn])) < 2 or len(set(y[held])) < 2:
        return Model(None, None, np.zeros(2), 0.0), 0
    views = [TextView(facts), MetaView(meta)]
    x = [views[0].active(facts), views[1].active(meta)]
    given = [np.full(len(y), np.nan), np.full(len(y), np.nan)]  # labels a view got from the other
    share = y[learn].mean()
    for r in range(rounds + 1):
        models = []
        for v in (0, 1):
            use = learn | ~np.isnan(given[v])
            target = np.where(learn, y, given[v])[use]
            models.append(Calibrated(views[v], x[v][use], target, np.where(learn[use], 1.0, 0.5), x[v][held], y[held]))
        if r == rounds:
            break
        for v in (0, 1):
            p = sigmoid(models[v].logit(x[v]))
            for label, sure, part in ((1.0, p, share), (0.0, 1 - p, 1 - share)):
                free = np.flatnonzero(~known & np.isnan(given[1 - v]) & (sure >= CONFIDENT))
                best = free[np.argsort(-sure[free], kind="stable")][:max(1, int(PER_ROUND * part))]
                given[1 - v][best] = label
    z = np.column_stack([m.logit(a[held]) for m, a in zip(models, x)])
    mix, shift = _line(z, y[held])
    return Model(models[0], models[1], mix, shift), int(sum((~np.isnan(g)).sum() for g in given))


META = ("lang", "source", "n_chars")


def _used(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("double").alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, keep, sample: int = SAMPLE, pool: int = POOL) -> Model:
    """Learns from at most ``sample`` labelled and ``pool`` unlabelled documents, both drawn by a hash of the id.

    The drawn ids are what is sent to the tasks, and only numbers and metadata of the drawn documents come
    back, so both are bounded by the parameters.
    """
    drawn = lambda ids, n: ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("double").alias("y"))
    free = docs.select("doc_id").filter(F.col("doc_id").isNotNull()).join(known.select("doc_id"), "doc_id", "left_anti").distinct()
    ids = drawn(known.filter(keep), sample).union(drawn(free, pool).select("doc_id", F.lit(None).cast("double")))
    picked = _used(docs).join(F.broadcast(ids), "doc_id")

    @F.pandas_udf("array<double>")
    def facts(texts: pd.Series) -> pd.Series:
        return pd.Series(list(text_facts(texts)))

    got = picked.select("doc_id", *META, "y", facts("text").alias("facts")).toArrow().to_pandas()
    got = got.assign(key=[tuple(f) for f in got["facts"]]).sort_values(["doc_id", "key"], kind="stable")  # one order, whatever the tasks' order
    held = got["doc_id"].map(lambda d: (d * 2654435761 >> 7) % 4 == 0).to_numpy(bool) if len(got) else np.zeros(0, bool)
    return co_train(np.array(list(got["facts"]), float).reshape(-1, TEXT_WIDTH), got[list(META)], got["y"].to_numpy(float), held)[0]


def score_column(model: Model):
    @F.pandas_udf("double")
    def score(texts: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.Series:
        return pd.Series(model.score(text_facts(texts), pd.DataFrame({"lang": lang, "source": source, "n_chars": n_chars})), dtype=float)

    return score


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document; 1 is good.

    Labels of held-out ids (crc32 of the id as text, mod 5, is 0) are never read. Without labels of both
    classes every score is 1. Null text is an empty text, unknown metadata shares one weight, repeated rows
    score alike, an empty table gives no rows.
    """
    model = train(docs, labels, part_of("doc_id") != 0)
    scored = _used(docs).select("doc_id", (part_of("doc_id") == 0).alias("held_out"), score_column(model)("text", *META).alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def kept_documents(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose score reaches ``least``, columns as they were."""
    model = train(docs, labels, part_of("doc_id") != 0)
    rows = docs.select(whole_row(docs).alias("row"))
    used = [F.col("row.text").cast("string"), F.col("row.lang").cast("string"), F.col("row.source").cast("string"), F.col("row.n_chars").cast("double")]
    return rows.select("row", score_column(model)(*used).alias("score")).filter(F.col("score") >= least).select("row.*")
