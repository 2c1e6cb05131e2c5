"""Text probability over all segmentations into the pieces of an existing vocabulary."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import exp, inf, log, log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runmosaic.llm.common import part_of, rows, words, written

VOCABULARY = "piece_bpe_32k.model"
HEAD = 1 << 17
HELD = 400_000
START = "▁"


@lru_cache(maxsize=1)
def _processor(name: str):
    import public_tokenizers as P
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=P.path(name))


def word_counts(docs: DataFrame) -> DataFrame:
    """``text, learn`` -> ``word, c``: every word of any document with its count in those to learn from.

    Each task adds up its words and hands over at most ``HELD`` entries at a time.
    """

    def out(c: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in c], pa.string()), pa.array(list(c.values()), pa.int64())], names=["word", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        for b in rows(batches):
            for text, learn in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if learn:
                    c.update(words(text))
                else:
                    for w in words(text):
                        c[w] += 0
                if len(c) > HELD:
                    yield out(c)
                    c = Counter()
        yield out(c)

    return docs.select("text", "learn").mapInArrow(run, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def piece_counts(types: DataFrame, name: str) -> DataFrame:
    """``piece, n``: how often the vocabulary's own segmentation of the counted words uses each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _processor(name)
        n = np.zeros(sp.vocab_size(), np.int64)
        for b in rows(batches, 1 << 20, "word"):
            for ids, c in zip(sp.encode(b.column(0).to_pylist(), num_threads=1), b.column(1).to_pylist()):
                np.add.at(n, ids, c)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used])], names=["piece", "n"])

    return types.filter("c > 0").select("word", "c").mapInArrow(run, "piece int, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))


class Lattice:
    """Log probabilities of the pieces, and of words as sums over all their segmentations."""

    def __init__(self, log_p: dict[str, float], bytes_: list[float], end: float):
        self.log_p, self.bytes, self.end = log_p, bytes_, end
        self.begins = {p[:k] for p in log_p for k in range(1, len(p) + 1)}

    @classmethod
    def of_counts(cls, counts: dict[int, int], ends: int, name: str = VOCABULARY) -> Lattice:
        """Unigram scores of the existing vocabulary: smoothed shares of its pieces and of the end of text."""
        sp = _processor(name)
        whole = sum(counts.values()) + ends + 0.5 * (sp.vocab_size() + 1)
        p = {i: log((counts.get(i, 0) + 0.5) / whole) for i in range(sp.vocab_size())}
        plain = {sp.id_to_piece(i): p[i] for i in p if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        return cls(plain, [p[sp.piece_to_id(f"<0x{b:02X}>")] for b in range(256)], log((ends + 0.5) / whole))

    def word(self, w: str) -> float:
        """Natural log of the summed probability, by the forward recursion in log space.

        A character that is no piece is spelt in byte pieces, the only way past it.
        """
        s = START + w
        n = len(s)
        into: dict[int, list[float]] = {0: [0.0]}
        log_p, begins = self.log_p, self.begins
        for i in range(n):
            terms = into.pop(i, None)
            if terms is None:
                continue
            if len(terms) == 1:
                a = terms[0]
            else:
                top = max(terms)
                a = top + log(sum([exp(t - top) for t in terms]))
            j = i + 1
            if s[i:j] not in log_p:
                into.setdefault(j, []).append(a + sum(self.bytes[b] for b in s[i].encode("utf-8", "surrogatepass")))
            while j <= n:
                piece = s[i:j]
                if piece not in begins:
                    break
                p = log_p.get(piece)
                if p is not None:
                    into.setdefault(j, []).append(a + p)
                j += 1
        terms = into.get(n, [-inf])
        top = max(terms)
        return top + log(sum(exp(t - top) for t in terms))


def type_scores(types: DataFrame, lattice: Lattice) -> DataFrame:
    """``word, c`` -> with ``lp``, the word's log10 probability; each different word is scored once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lp = [lattice.word(w) / log(10) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lp, pa.float64())], names=["word", "c", "lp"])

    return types.mapInArrow(run, "word string, c bigint, lp double")


PARTS = "loc bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, rest array<struct<w: string, n: bigint>>"
REST = pa.list_(pa.struct([("w", pa.string()), ("n", pa.int64())]))


def head_scores(docs: DataFrame, head: dict[bytes, tuple[int, float]], log_c, end: tuple[bool, float, float]) -> DataFrame:
    """Per document the sums over its frequent words, and its other words with their counts in ``rest``."""
    known_end, base_end, score_end = end
    table = {w: (c > 0, log_c(c), lp) for w, (c, lp) in head.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            out = []
            for text in b.column(3).to_pylist():
                found = words(text)
                known, base, score, rest = int(known_end), base_end, score_end, []
                for w, n in Counter(found).items():
                    hit = table.get(w)
                    if hit is None:
                        rest.append({"w": w.decode("utf-8", "replace"), "n": n})
                    else:
                        known += n * hit[0]
                        base += n * hit[1]
                        score += n * hit[2]
                out.append((len(found) + 1, known, base, score, rest))
            n, known, base, score, rest = (list(x) for x in zip(*out)) if out else ([],) * 5
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()),
                                              pa.array(score, pa.float64()), pa.array(rest, REST)], names=["loc", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rest"])

    return docs.select("loc", "doc_id", "held_out", "text").mapInArrow(run, PARTS)


def score_texts(docs: DataFrame, held_out, name: str = VOCABULARY, head: int = HEAD) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every document.

    Counts come from all rows that are not ``held_out``. The vocabulary exists already and is not trained; its
    file holds merge ranks, so its pieces get unigram scores from the counted words. A text's probability is
    the product over its words and one end, each word summed over all its segmentations.

    The ``head`` most frequent words (at most, a bound on what is broadcast) are looked up where texts are read;
    all others meet their counts and scores in a shuffle join, so nothing is left out and no word's rows gather
    in one task.

    Null text is empty, with the end as its only token. Repeated rows are scored, and counted, each by itself.
    Without rows to learn from every count is 0. An empty table gives an empty result.
    """
    used = docs.select(F.monotonically_increasing_id().alias("loc"), F.col("doc_id").cast("bigint").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    types = written(word_counts(used.select("text", (~F.col("held_out")).alias("learn"))), "lm-words")
    ends = used.filter("not held_out").count()
    total = types.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n, v = total.n + ends, total.v + (ends > 0)
    log_c = lambda c: log10((c + 0.5) / (n + 0.5 * (v + 1)))
    lattice = Lattice.of_counts({r.piece: r.n for r in piece_counts(types, name).collect()}, ends, name)  # one row per piece of the vocabulary
    scored = written(type_scores(types, lattice), "lm-types")
    most = scored.orderBy(F.desc("c"), "word").limit(head).toArrow()
    top = dict(zip(map(str.encode, most.column("word").to_pylist()), zip(most.column("c").to_pylist(), most.column("lp").to_pylist())))
    parts = written(head_scores(used, top, log_c, (ends > 0, log_c(ends), lattice.end / log(10))), "lm-parts")
    base = F.log10((F.col("c") + 0.5) / F.lit(n + 0.5 * (v + 1)))
    rest = parts.select("loc", F.explode("rest").alias("r")).select("loc", F.col("r.w").alias("word"), "r.n").join(scored, "word").groupBy("loc").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k"), F.sum(base * F.col("n")).alias("b"), F.sum(F.col("lp") * F.col("n")).alias("s"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return parts.drop("rest").join(rest, "loc", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("k")).alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base") + zero("b")).alias("base_score"), (F.col("score") + zero("s")).alias("score"))


def lm_report(docs: DataFrame) -> DataFrame:
    return score_texts(docs, part_of("doc_id") == 1)
