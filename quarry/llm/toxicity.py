"""Toxic passages as maximum-scoring segments of token log-odds.

Training: word counts (documents holding the word) of the toxic and the clean
labelled rows are compared by log-odds with an informative Dirichlet prior,
whose shape is the word's count over *all* documents.  Words that are surely
toxic (log-odds of at least ``MIN_LOG_ODDS``, and a likelihood-ratio test of
the word's toxic and clean rows with a z score of at least ``Z`` and so high
that of all tested words less than one is expected there by chance) score
their log-odds; every other word
scores the same negative drift, so a segment must stay dense in toxic words.
The test rises with the toxic rows also for a word no clean row holds.

Scoring: a linear-time scan finds all maximal scoring segments of a text.  A
segment of score S in a text of n words has the extreme-value expectation
E = K n exp(-lambda S), lambda solving sum p exp(lambda s) = 1 over the
clean word distribution; segments with E <= ``E_MAX`` are significant and
their -ln E are added up.  A one-variable logistic curve, fitted on labelled
rows, turns the sum into a probability.

Only the training rows (remainder of crc32(doc_id) by 5 not 0) teach labels,
at most ``MAX_TRAIN`` of them (taken by hash; a documented bound of the
classifier's sample); the prior counts cover all documents.  The model holds
words of toxic training rows only, so that bound is its size bound too.

Defined cases: null and empty texts have no words and get the curve's value
at 0; null labels and labels without a document teach nothing; equal texts
with one label teach once; without toxic (or clean) training rows every score is 0
(or, with toxic rows alone, their model's); no column but the text enters a score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import words as W
from quarry.llm.io import give_back, gives_back, staged

MAX_TRAIN = 200_000
PRIOR_WORDS = 50.0     # weight of the Dirichlet prior, in documents' words
Z, MIN_LOG_ODDS, MIN_DOCS, E_MAX = 3.0, 3.5, 2, 0.05
_COUNTS = "word long, toxic int, n long"
_RESULT = "evidence double, segments array<struct<start:int,end:int,score:double,e_value:double>>"


@dataclass
class Model:
    words: np.ndarray       # sorted uint64 word hashes that score above 0
    scores: np.ndarray
    drift: float            # score of any other word, negative
    lam: float
    k: float
    intercept: float = 0.0
    slope: float = 0.0
    empty: bool = True


def in_training(doc_id) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def labelled(documents: DataFrame, labels: DataFrame, max_train: int) -> DataFrame:
    """(text, toxic) of the training rows, a bounded share by hash if there are too many."""
    lab = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")) \
        .filter(F.col("toxic").isin(0, 1) & F.col("_id").isNotNull() & in_training(F.col("_id")))
    n = lab.count()
    if n > max_train:
        lab = lab.filter(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(1_000_000 * max_train / n))
    # at most about max_train rows, so they go to the documents and no text is shuffled
    docs = documents.select(F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_h"), "text")
    found = docs.join(F.broadcast(lab), F.col("_d") == F.col("_id"))
    # copies of one text would pass their chance words off as evidence: the smallest doc_id teaches
    taught = staged(found.groupBy("_h", "toxic").agg(F.min("_d").alias("_id")), "toxicity-labels")
    taught = F.broadcast(taught.withColumnRenamed("_h", "_t"))
    return docs.join(taught, (F.col("_d") == F.col("_id")) & (F.col("_h") == F.col("_t"))).select("text", "toxic")


def _documents_per_word(only: np.ndarray | None):
    """Partial document counts of words per batch (of the words in ``only``, if given)."""
    @gives_back
    def run(batches):
        for batch in batches:
            texts = W.text_column(batch, "text")
            toxic = W.text_column(batch, "toxic").to_numpy(zero_copy_only=False)
            for a, b in W.pieces(texts):
                w = W.word_table(texts.slice(a, b - a), W.LETTERS_LOWER)
                h, owner = w.hash, w.owner()
                if only is not None:
                    keep = _find(only, h) >= 0
                    h, owner = h[keep], owner[keep]
                order = np.lexsort((owner, h))
                h, owner = h[order], owner[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
                h, y = h[new], toxic[a:b][owner[new]]
                for label in np.unique(toxic[a:b]):
                    u, n = np.unique(h[y == label], return_counts=True)
                    u = np.concatenate([u, np.zeros(1, np.uint64)])     # word 0: documents
                    n = np.concatenate([n, [(toxic[a:b] == label).sum()]])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(u.view(np.int64)), pa.array(np.full(len(u), label, np.int32)),
                         pa.array(n.astype(np.int64))], ["word", "toxic", "n"])
    return run


def _find(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Index of each hash in a sorted table, or -1."""
    if not len(table):
        return np.full(len(h), -1)
    i = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return np.where(table[i] == h, i, -1)


def _partial_counts(df: DataFrame, only=None) -> DataFrame:
    return df.mapInArrow(_documents_per_word(only), _COUNTS)


def likelihood_z(t, n_t: int, c, n_c: int) -> np.ndarray:
    """Signed root of the likelihood ratio: t of n_t toxic and c of n_c clean rows against one common share."""
    t, c, n = np.asarray(t, float), np.asarray(c, float), n_t + n_c
    ratio = np.zeros(np.broadcast(t, c).shape)
    for seen, rows, held in ((t, n_t, t + c), (n_t - t, n_t, n - t - c), (c, n_c, t + c), (n_c - c, n_c, n - t - c)):
        ratio += 2 * seen * np.log(np.maximum(seen, 1e-300) / np.maximum(held * rows / n, 1e-300))
    return np.sqrt(np.maximum(ratio, 0)) * np.sign(t * n_c - c * n_t)


def train(documents: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    rows = labelled(documents, labels, max_train)
    pair = staged(_partial_counts(rows).groupBy("word").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c")), "toxicity-words")
    # words that never win stay on the executors; the rest is bounded by the training sample
    base = pair.filter("word = 0").first()
    n_t, n_c = (int(base.t), int(base.c)) if base else (0, 0)
    if not n_t:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -1.0, 1.0, 1.0)
    won = pair.filter((F.col("word") != 0) & (F.col("t") >= MIN_DOCS)
                      & (F.col("t") * F.lit(float(max(n_c, 1))) > F.col("c") * F.lit(4.0 * n_t))).toPandas()
    words = won["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(words)
    words, t, c = words[order], won["t"].to_numpy(float)[order], won["c"].to_numpy(float)[order]
    prior = {r.word: r.n for r in _partial_counts(documents.select("text", F.lit(0).alias("toxic")), words)
             .groupBy("word").agg(F.sum("n").alias("n")).collect()}
    n_all = max(1, prior.get(0, 1))
    alpha = PRIOR_WORDS * np.array([prior.get(int(x), 1) for x in words.view(np.int64)], float) / n_all + 1e-2
    a0 = PRIOR_WORDS
    odds = lambda y, n: np.log(y + alpha) - np.log(np.maximum(n + a0 - y - alpha, 1.0))
    delta = odds(t, n_t) - odds(c, n_c)
    tested, total_c = pair.filter("word <> 0").agg(
        F.count(F.when(F.col("t") + F.col("c") >= MIN_DOCS, 1)), F.sum("c")).first()
    chance = NormalDist().inv_cdf(1 - 1 / max(2, tested))      # less than one of the tested words by chance
    keep = (likelihood_z(t, n_t, c, n_c) >= max(Z, chance)) & (delta >= MIN_LOG_ODDS)
    words, scores, c = words[keep], delta[keep], c[keep]
    drift = -max(0.02, 0.02 * float(np.median(scores)) if len(scores) else 0.02)
    # share of clean words that score: its documents over all clean words' documents
    total_c = float(total_c or 1)
    p = (c + 0.5 / max(1, len(c))) / (total_c + 1)
    lam = _lambda(p, scores, drift)
    model = Model(words, scores, drift, lam, float(max(p.sum(), 1e-9)), empty=not len(words))
    if not model.empty:
        model.intercept, model.slope = _curve(rows, model)
    return model


def _lambda(p, s, drift) -> float:
    """The positive root of sum p exp(lam s) + (1 - sum p) exp(lam drift) = 1."""
    def f(x):
        return float((p * np.exp(np.minimum(x * s, 500))).sum() + (1 - p.sum()) * math.exp(x * drift) - 1)
    if not len(s):
        return 1.0
    hi = 1e-3
    while f(hi) <= 0 and hi < 50:
        hi *= 2
    lo = 0.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) <= 0 else (lo, mid)
    return hi


def segments(at: np.ndarray, score: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (from, to, score); ``at`` holds the scoring words, ``drift`` the rest."""
    stack: list[list] = []           # [left sum, right sum, from, to, place of the nearest earlier one with a smaller left sum]
    total, before = 0.0, 0
    for i, s in zip(at.tolist(), score.tolist()):
        total += drift * (i - before)
        left, total, before = total, total + s, i + 1
        new, j = [left, total, i, i + 1, -1], len(stack) - 1
        while True:
            while j >= 0 and stack[j][0] >= new[0]:       # all that j passed over have larger left sums still
                j = stack[j][4]
            if j < 0 or stack[j][1] >= new[1]:
                break
            new = [stack[j][0], new[1], stack[j][2], new[3], -1]
            j, keep = stack[j][4], j
            del stack[keep:]
        new[4] = j
        stack.append(new)
    return [(a, b, r - l) for l, r, a, b, _ in stack]


def _scan(texts: pa.Array, m: Model) -> list[tuple[float, list]]:
    w = W.word_table(texts, W.LETTERS_LOWER)
    i = _find(m.words, w.hash)
    hits = np.flatnonzero(i >= 0)
    bounds = np.searchsorted(hits, w.first)
    n = w.counts()
    out = [(0.0, [])] * len(w)
    for d in np.flatnonzero(np.diff(bounds)):
        mine = hits[bounds[d]:bounds[d + 1]]
        found, evidence = [], 0.0
        for a, b, s in segments(mine - w.first[d], m.scores[i[mine]], m.drift):
            log_e = math.log(m.k * int(n[d])) - m.lam * s
            if log_e <= math.log(E_MAX):
                found.append({"start": a, "end": b, "score": s, "e_value": math.exp(max(log_e, -700))})
                evidence -= log_e
        out[d] = (evidence, found)
    return out


def _scanner(model: Model):
    seg = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()),
                              ("e_value", pa.float64())]))

    def run(column: pa.Array) -> pa.Array:
        rows = [r for a, b in W.pieces(column) for r in _scan(column.slice(a, b - a), model)]
        give_back()
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.float64()),
                                           pa.array([r[1] for r in rows], seg)], ["evidence", "segments"])
    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, _RESULT)


def _curve(rows: DataFrame, model: Model) -> tuple[float, float]:
    """Logistic fit of label on evidence, over a histogram of evidence (at most 400 bins a label)."""
    e = F.least(_scanner(model)(F.col("text"))["evidence"], F.lit(100.0))
    bins = rows.select(F.round(e * 4).alias("x"), "toxic").groupBy("x", "toxic").count().collect()
    x = np.array([r.x / 4 for r in bins])
    y = np.array([r.toxic for r in bins], float)
    n = np.array([r["count"] for r in bins], float)
    beta, feats = np.zeros(2), np.stack([np.ones_like(x), x], 1)
    for _ in range(100):                        # Newton steps, lightly ridged so that a clean split ends
        p = 1 / (1 + np.exp(-np.clip(feats @ beta, -30, 30)))
        grad = feats.T @ (n * (y - p)) - 1e-2 * beta
        hess = (feats * (n * p * (1 - p) + 1e-9)[:, None]).T @ feats + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta += step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(max(beta[1], 0.0))


def with_toxicity(documents: DataFrame, model: Model, text: str = "text", into: str = "toxicity") -> DataFrame:
    """``documents`` with a struct column ``into``: score (0 to 1), evidence and the significant segments."""
    if model.empty:
        none = F.array().cast("array<struct<start:int,end:int,score:double,e_value:double>>")
        return documents.withColumn(into, F.struct(F.lit(0.0).alias("score"), F.lit(0.0).alias("evidence"),
                                                   none.alias("segments")))
    raw = "_scan_of_" + into
    scanned = documents.withColumn(raw, _scanner(model)(F.col(text)))
    z = F.lit(model.intercept) + F.lit(model.slope) * F.col(raw)["evidence"]
    return scanned.withColumn(into, F.struct(
        (1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))).alias("score"),
        F.col(raw)["evidence"].alias("evidence"), F.col(raw)["segments"].alias("segments"))).drop(raw)


def op3_toxicity(spark, sf_dir) -> DataFrame:
    """Toxicity score of every document, learnt from the training rows of ``labels``."""
    from quarry.llm.io import read

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels"))
    t = F.col("toxicity")
    return with_toxicity(docs, model).select(
        "doc_id", (F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5, F.lit(1)) == 0)
        .alias("held_out"), t["score"].alias("score"), (t["score"] >= 0.5).cast("int").alias("predicted"),
        F.size(t["segments"]).alias("n_segments"))
