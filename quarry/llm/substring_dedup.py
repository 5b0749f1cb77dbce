"""Substring dedup by difference-cover anchors.

A window is ``WINDOW`` consecutive words.  Positions of a document whose
remainder by ``PERIOD`` lies in a difference cover carry an anchor, a hash
of the next ``ANCHOR`` words.  For any two places some shift below the
period puts both on cover positions, and anchor + period - 1 = window, so
two equal windows share an aligned anchor.  Only windows around anchors that
occur twice are candidates; they are compared on all their words (95 bits of
hash) and the words of those that start anywhere else too are removed.

Repeats inside one piece of a partition are settled there and announced once,
so a passage that a third of all documents hold reaches its reducer as one
row a piece.  Of the candidates only the few that fail travel back to their
document.

Defined cases: a null or short text has no windows and keeps all its words;
equal rows are places of their own, so their windows repeat; an empty table gives
no rows; extra columns do not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import words as W
from quarry.llm.io import staged

WINDOW = 35
PERIOD, COVER = 21, (3, 6, 7, 12, 14)       # every remainder is a difference of two of them
ANCHOR = WINDOW - PERIOD + 1


def _repeats(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mask of values that occur once, the values that occur more often)."""
    u, back, n = np.unique(h, return_inverse=True, return_counts=True)
    return n[back] == 1, u[n > 1]


def _rows(columns: dict, repeated: dict) -> pa.RecordBatch:
    """Rows of single values, then one announcement (no place, m = 2) per repeated value."""
    arrays = [pa.concat_arrays([pa.array(columns[c]), pa.array(repeated[c]) if c in repeated
                                else pa.nulls(len(repeated["m"]), pa.array(columns[c]).type)]) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, list(columns))


def _anchors(batches):
    cover = np.isin(np.arange(PERIOD), COVER)
    for batch in batches:
        texts = W.text_column(batch, "text")
        keys = W.text_column(batch, "key").to_numpy(zero_copy_only=False)
        for a, b in W.pieces(texts):
            w = W.word_table(texts.slice(a, b - a), W.SPACED)
            owner, left, n = w.owner(), w.left(), w.counts()
            place = np.arange(len(owner)) - w.first[owner]
            at = np.flatnonzero(cover[place % PERIOD] & (left >= ANCHOR) & (n[owner] >= WINDOW))
            if not len(at):
                continue
            g = W.ngrams(w.hash, ANCHOR)[at]
            key, pos = keys[a:b][owner[at]], place[at].astype(np.int32)
            once, often = _repeats(g)
            # a place of a repeated anchor goes under a hash of its own, already counted twice
            g = np.where(once, g, W.mix(key.view(np.uint64) + pos.astype(np.uint64), 31))
            yield _rows({"a": g.view(np.int64), "key": key, "pos": pos, "m": np.where(once, 1, 2).astype(np.int32)},
                        {"a": often.view(np.int64), "m": np.full(len(often), 2, np.int32)})


def _candidate_starts(w: W.Words, anchors: pa.Array) -> np.ndarray:
    """Windows (by first word) that hold a repeated anchor of their document."""
    anchors = anchors.cast(pa.large_list(pa.int64()))
    n = np.diff(np.asarray(anchors.offsets))
    doc = np.repeat(np.arange(len(n)), n)
    q = w.first[doc] + anchors.flatten().to_numpy(zero_copy_only=False)
    low = np.maximum(q - (WINDOW - ANCHOR), w.first[doc])
    high = np.minimum(q, w.first[doc + 1] - WINDOW)
    ok = high >= low
    step = np.zeros(len(w.start) + 1, np.int64)
    np.add.at(step, low[ok], 1)
    np.add.at(step, high[ok] + 1, -1)
    return np.flatnonzero(np.cumsum(step[:-1]) > 0)


def _windows(batches):
    for batch in batches:
        texts, anchors = W.text_column(batch, "text"), W.text_column(batch, "anchors")
        keys = W.text_column(batch, "key").to_numpy(zero_copy_only=False)
        for a, b in W.pieces(texts):
            w = W.word_table(texts.slice(a, b - a), W.SPACED)
            at = _candidate_starts(w, anchors.slice(a, b - a))
            if not len(at):
                continue
            h = W.ngrams(w.hash, WINDOW)[at]
            more = W.ngrams(w.hash, WINDOW, 5)[at] >> np.uint64(33)          # 31 further bits
            owner = w.owner()[at]
            place = (at - w.first[owner]).astype(np.uint64)
            order = np.lexsort((more, h))
            new = np.ones(len(at), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (more[order][1:] != more[order][:-1])
            n = np.diff(np.append(np.flatnonzero(new), len(at)))
            once = np.zeros(len(at), bool)
            once[order] = np.repeat(n, n) == 1
            packed = ((more << np.uint64(32)) | place)
            often = order[new][n > 1]
            yield _rows({"h": h[once].view(np.int64), "key": keys[a:b][owner[once]], "packed": packed[once].view(np.int64),
                         "m": np.ones(int(once.sum()), np.int32)},
                        {"h": h[often].view(np.int64), "packed": (more[often] << np.uint64(32)).view(np.int64),
                         "m": np.full(len(often), 2, np.int32)})


def _kept(w: W.Words, removed: np.ndarray, digest: bool) -> list[tuple]:
    """(n_words, n_removed, kept words joined by a space or their digest) of every text."""
    out = []
    for d in range(len(w)):
        a, b = int(w.first[d]), int(w.first[d + 1])
        keep = np.flatnonzero(~removed[a:b]) + a
        text = b" ".join([w.data[s:e].tobytes() for s, e in zip(w.start[keep].tolist(), w.end[keep].tolist())])
        out.append((b - a, b - a - len(keep), hashlib.sha256(text).hexdigest() if digest else text.decode("utf-8", "replace")))
    return out


_RESULT = "n_words long, n_removed long, kept string"


def _result(rows) -> pa.Array:
    cols = list(zip(*rows)) or [(), (), ()]
    return pa.StructArray.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                                       pa.array(cols[2], pa.string())], ["n_words", "n_removed", "kept"])


def _untouched(digest: bool):
    """Result of texts without a repeated anchor (null for the others)."""
    def run(texts: pa.Array, anchors: pa.Array) -> pa.Array:
        clean = np.asarray(anchors.is_null())
        rows = []
        for a, b in W.pieces(texts):
            some = texts.slice(a, b - a).filter(pa.array(clean[a:b]))
            w = W.word_table(some, W.SPACED)
            found = iter(_kept(w, np.zeros(len(w.start), bool), digest))
            rows += [next(found) if c else (None, None, None) for c in clean[a:b]]
        return _result(rows)
    run.__annotations__ = {"texts": pa.Array, "anchors": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, _RESULT)


def _cleaned(digest: bool):
    """Result of texts with repeated anchors: all candidate windows count but the failing ones."""
    def run(texts: pa.Array, anchors: pa.Array, failing: pa.Array) -> pa.Array:
        rows = []
        for a, b in W.pieces(texts):
            w = W.word_table(texts.slice(a, b - a), W.SPACED)
            starts = np.zeros(len(w.start) + 1, bool)
            starts[_candidate_starts(w, anchors.slice(a, b - a))] = True
            for d, bad in enumerate(failing.slice(a, b - a).to_pylist()):
                if bad:
                    starts[w.first[d] + np.array(bad, np.int64)] = False
            at = np.flatnonzero(starts)
            step = np.zeros(len(w.start) + 1, np.int64)
            np.add.at(step, at, 1)
            np.add.at(step, at + WINDOW, -1)
            rows += _kept(w, np.cumsum(step[:-1]) > 0, digest)
        return _result(rows)
    run.__annotations__ = {"texts": pa.Array, "anchors": pa.Array, "failing": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, _RESULT)


def dedup_substrings(documents: DataFrame, text: str = "text", keep=("doc_id",), digest: bool = False) -> DataFrame:
    """Every document: columns ``keep``, n_words, n_removed and kept (the kept words joined by a
    space, or with ``digest`` their SHA-256)."""
    docs = documents.select(*keep, F.col(text).alias("_text"), F.xxhash64(*documents.columns).alias("_key"))
    rows = docs.select(F.col("_key").alias("key"), F.col("_text").alias("text"))
    found = rows.mapInArrow(_anchors, "a long, key long, pos int, m int")
    found = found.withColumn("s", F.sum("m").over(Window.partitionBy("a"))).filter("s > 1 and key is not null")
    anchors = staged(found.groupBy(F.col("key").alias("_a")).agg(F.collect_list("pos").alias("_anchors")), "anchors")
    joined = docs.join(anchors, F.col("_key") == F.col("_a"), "left").drop("_a")
    joined = staged(joined.withColumn("_r", _untouched(digest)("_text", "_anchors"))
                    .withColumn("_text", F.when(F.col("_anchors").isNotNull(), F.col("_text"))), "anchored")
    touched = joined.filter("_anchors is not null")
    windows = touched.select(F.col("_key").alias("key"), F.col("_text").alias("text"), F.col("_anchors").alias("anchors")) \
        .mapInArrow(_windows, "h long, key long, packed long, m int")
    bits = F.shiftright("packed", 32)
    single = windows.withColumn("s", F.sum("m").over(Window.partitionBy("h", bits))).filter("s = 1")
    failing = single.groupBy(F.col("key").alias("_f")).agg(
        F.collect_list(F.col("packed").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")).alias("_failing"))
    mended = touched.drop("_r").join(failing, F.col("_key") == F.col("_f"), "left").withColumn(
        "_r", _cleaned(digest)("_text", "_anchors", "_failing"))
    out = [*keep, "_r.n_words", "_r.n_removed", "_r.kept"]
    return joined.filter("_anchors is null").select(*out).unionByName(mended.select(*out))


def op7_substring_dedup(spark, sf_dir) -> DataFrame:
    """What remains of every document without 35-word passages that start anywhere else too."""
    from quarry.llm.io import read

    return dedup_substrings(read(spark, sf_dir, "documents").select("doc_id", "text"), digest=True) \
        .withColumnRenamed("kept", "kept_sha256")
