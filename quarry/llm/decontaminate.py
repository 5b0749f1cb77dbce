"""Benchmark decontamination by winnowing.

Texts are lower-cased (A-Z) and cut into words of letters, digits and
non-ASCII.  A k-gram hash is kept if it is the smallest (the rightmost, in
ties) of some window of ``window - k + 1`` consecutive k-grams, so two texts
sharing ``window`` words share a kept fingerprint at the same place of the
shared span.  Kept fingerprints of the documents are joined with those of the
benchmark; a hit extends to the windows around it, those that are windows of an
item, compared byte by byte, mark their words, and neighbouring ones make up the
shared span.  Items keep each distinct window once with the items that hold it,
so a word repeated thousands of times on both sides costs what other text does.
An item of fewer words is one window, looked up at every place.

A benchmark of at most ``block_bytes`` of text travels to the tasks whole, and
documents are never shuffled.  A larger one is winnowed where it lies and never
passes through the driver: its fingerprints are joined with those of the
documents as tables, texts that share one are looked at again, their windows
around the hits are joined with the items' distinct windows on all their words,
and spans and items come back to the documents by the text's 128-bit hash.

Defined cases: a null or empty text has no words and is never contaminated;
a null or empty item has no windows; item ids are compared as strings, a
null id as the empty string, and items sharing an id count once; repeated
documents are judged alike; an empty benchmark hits nothing.  A column of the
documents that is called like the result (``into``) gives way to it.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import words as W
from quarry.llm.io import give_back, staged, utf8_bytes

WINDOW, K = 13, 7
BLOCK_BYTES = 16 << 20
_RESULT = "n_words long, spans array<int>, items array<string>"


def winnow(h: np.ndarray, left: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) kept by winnowing; ``left`` is the words left in each word's text."""
    g = W.ngrams(h, k)
    span = window - k + 1
    if len(g) < span:
        return np.zeros(0, np.int64), g[:0]
    if span == 1:
        at = np.flatnonzero(left[:len(g)] >= k)
        return at, g[at]
    starts = np.flatnonzero(left[:len(g) - span + 1] >= window)
    if not len(starts):
        return starts, g[:0]
    back = sliding_window_view(g, span)[:, ::-1].argmin(axis=1)
    at = starts + span - 1 - back[starts]
    keep = np.zeros(len(g), bool)
    keep[at] = True
    at = np.flatnonzero(keep)
    return at, g[at]


class _Windows:
    """The distinct windows of one length of some items: hashes in order, a place of each and the items that hold it."""

    def __init__(self, w: W.Words, owner: np.ndarray, starts: np.ndarray, length: int):
        h = W.ngrams(w.hash, length)[starts] if len(starts) else w.hash[:0]
        order = np.lexsort((owner[starts], h))
        h, starts, item = h[order], starts[order], owner[starts][order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        once = new.copy()
        once[1:] |= item[1:] != item[:-1]
        self.length, self.hash, self.place = length, h[new], starts[new]
        self.items = item[once]                              # items[first[u]:first[u + 1]] hold window u
        self.first = np.concatenate([np.searchsorted(np.cumsum(new)[once], np.arange(1, new.sum() + 1)), [once.sum()]])

    def find(self, w: W.Words, items: W.Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document places, windows) of the places in ``at`` that hold a window, byte for byte."""
        if not len(self.hash) or not len(at):
            return at[:0], at[:0]
        h = W.ngrams(w.hash, self.length)[at]
        u = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        same = self.hash[u] == h
        at, u = at[same], u[same]
        ok = np.zeros(len(at), bool)
        for a in range(0, len(at), 1 << 15):
            ok[a:a + (1 << 15)] = _same_words(w, at[a:a + (1 << 15)], items, self.place[u[a:a + (1 << 15)]], self.length)
        return at[ok], u[ok]


def _same_words(a: W.Words, i: np.ndarray, b: W.Words, j: np.ndarray, n: int) -> np.ndarray:
    """Whether the n words of a from i and those of b from j are the same bytes."""
    i, j = (i[:, None] + np.arange(n)).ravel(), (j[:, None] + np.arange(n)).ravel()
    size = a.end[i] - a.start[i]
    alike = size == b.end[j] - b.start[j]
    size = np.where(alike, size, 0)
    first = np.cumsum(size) - size
    ramp = np.arange(size.sum()) - np.repeat(first, size)
    differ = a.data[np.repeat(a.start[i], size) + ramp] != b.data[np.repeat(b.start[j], size) + ramp]
    wrong = np.bincount(np.repeat(np.arange(len(i)), size), differ, minlength=len(i)) > 0
    return (alike & ~wrong).reshape(-1, n).all(axis=1)


class _Items:
    """Benchmark side: words of a block of items, their fingerprints, and their windows by length."""

    def __init__(self, ids: list, texts: list, window: int, k: int):
        self.ids = ["" if i is None else str(i) for i in ids]
        self.words = w = W.word_table(pa.array(texts, pa.string()), W.LETTERS_LOWER)
        n, owner, left = w.counts(), w.owner(), w.left()
        self.fp = np.unique(winnow(w.hash, left, k, window)[1])
        self.whole = _Windows(w, owner, np.flatnonzero(left >= window), window)
        self.short = [_Windows(w, owner, w.first[:-1][n == length], int(length)) for length in np.unique(n[(n > 0) & (n < window)])]


def _scan(texts: pa.Array, items: _Items, window: int, k: int) -> list[tuple]:
    """(n_words, covered word spans, items) of every text.

    A hit fingerprint extends to the windows around it, which are looked up among the items' distinct
    windows; however often a window repeats on either side, each place is looked at once."""
    w = W.word_table(texts, W.LETTERS_LOWER)
    left, owner, total = w.left(), w.owner(), len(w.start)
    at, fp = winnow(w.hash, left, k, window)
    at = at[np.isin(fp, items.fp)]
    around = np.unique(at[:, None] - np.arange(window - k + 1))
    around = around[around >= 0]
    found = [(items.whole, *items.whole.find(w, items.words, around[left[around] >= window]))]
    found += [(t, *t.find(w, items.words, np.flatnonzero(left >= t.length))) for t in items.short]
    edges = np.zeros(total + 1, np.int64)
    named: list[set] = [set() for _ in range(len(w))]
    for table, s, u in found:
        np.add.at(edges, s, 1)
        np.add.at(edges, s + table.length, -1)
        for d, x in np.unique(np.stack([owner[s], u], 1), axis=0) if len(s) else ():
            named[d].update(items.ids[i] for i in table.items[table.first[x]:table.first[x + 1]])
    hit = np.cumsum(edges)[:total] > 0
    begins, stops = hit.copy(), hit.copy()
    begins[1:] &= ~hit[:-1] | (owner[1:] != owner[:-1])
    stops[:-1] &= ~hit[1:] | (owner[1:] != owner[:-1])
    begins, stops = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    spans: list[list] = [[] for _ in range(len(w))]
    for d, s, e in zip(owner[begins].tolist(), begins.tolist(), stops.tolist()):
        spans[d] += [s - int(w.first[d]), e - int(w.first[d])]
    return list(zip(w.counts().tolist(), spans, named))


def _scanner(ids, texts, window, k):
    cell = []

    def run(column: pa.Array) -> pa.Array:
        if not cell:
            cell.append(_Items(ids, texts, window, k))
        rows = [r for a, b in W.pieces(column) for r in _scan(column.slice(a, b - a), cell[0], window, k)]
        give_back()
        return pa.StructArray.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()),
             pa.array([r[1] for r in rows], pa.list_(pa.int32())),
             pa.array([sorted(r[2]) for r in rows], pa.list_(pa.string()))],
            ["n_words", "spans", "items"])

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, _RESULT)


# ------------------------------------------------- a benchmark above one block
_ITEM_ROWS = "len int, fp long, w binary, i string"      # fingerprints (len 0; whole short items) and windows


def _joined_words(w: W.Words, at: np.ndarray, length: int) -> list[bytes]:
    """The ``length`` words from each place in ``at``, joined by a space."""
    words = {int(p): w.data[w.start[p]:w.end[p]].tobytes()
             for p in np.unique(at[:, None] + np.arange(length))} if len(at) else {}
    return [b" ".join([words[p + j] for j in range(length)]) for p in at.tolist()]


def _item_rows(batches, window: int, k: int):
    """Of every item: its fingerprints, and its windows, each once."""
    for batch in batches:
        texts, ids = W.text_column(batch, "t"), W.text_column(batch, "i").to_pylist()
        for a, b in W.pieces(texts):
            w = W.word_table(texts.slice(a, b - a), W.LETTERS_LOWER)
            owner, left, n = w.owner(), w.left(), w.counts()
            rows = {(0, fp, None, None) for fp in winnow(w.hash, left, k, window)[1].view(np.int64).tolist()}
            at = np.flatnonzero(left >= window)
            rows.update((window, None, x, ids[a + d]) for x, d in zip(_joined_words(w, at, window), owner[at].tolist()))
            for length in np.unique(n[(n > 0) & (n < window)]).tolist():
                at = w.first[:-1][n == length]
                fps = W.ngrams(w.hash, length)[at].view(np.int64).tolist()
                rows.update((length, fp, x, ids[a + d])
                            for fp, x, d in zip(fps, _joined_words(w, at, length), owner[at].tolist()))
            yield _batch(list(zip(*rows)) or [()] * 4, _ITEM_ROWS)


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


_PRINTS = "key binary, len int, fp long"


def _prints(batches, window: int, k: int, short: list):
    """The fingerprints of every text, and its n-grams as long as short items, each once."""
    for batch in batches:
        texts, keys = W.text_column(batch, "text"), batch.column("key")
        for a, b in W.pieces(texts):
            w = W.word_table(texts.slice(a, b - a), W.LETTERS_LOWER)
            owner, left = w.owner(), w.left()
            kinds = [(0, *winnow(w.hash, left, k, window))]
            for length in short:
                at = np.flatnonzero(left >= length)
                kinds.append((length, at, W.ngrams(w.hash, length)[at] if len(at) else w.hash[:0]))
            for length, at, fp in kinds:
                if not len(at):
                    continue
                order = np.lexsort((fp, owner[at]))
                d, fp = owner[at][order], fp[order]
                once = np.ones(len(d), bool)
                once[1:] = (d[1:] != d[:-1]) | (fp[1:] != fp[:-1])
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(a, b - a).take(pa.array(d[once])), pa.array(np.full(int(once.sum()), length, np.int32)),
                     pa.array(fp[once].view(np.int64))], ["key", "len", "fp"])


_PLACES = "key binary, place int, len int, w binary"


def _places(batches, window: int, k: int):
    """The windows around hit fingerprints of every text, and its n-grams that may be short items."""
    for batch in batches:
        texts, keys, prints = W.text_column(batch, "text"), batch.column("key"), batch.column("prints")
        for a, b in W.pieces(texts):
            w = W.word_table(texts.slice(a, b - a), W.LETTERS_LOWER)
            left = w.left()
            at, fp = winnow(w.hash, left, k, window)
            for d in range(len(w)):
                hit: dict[int, list] = {}
                for p in prints[a + d].as_py():
                    hit.setdefault(p["len"], []).append(p["fp"])
                first, end = int(w.first[d]), int(w.first[d + 1])
                for length, fps in hit.items():
                    fps = np.array(fps, np.int64).view(np.uint64)
                    if length:
                        starts = np.arange(first, end - length + 1)
                        starts = starts[np.isin(W.ngrams(w.hash, length)[starts], fps)]
                    else:
                        x, y = np.searchsorted(at, [first, end])
                        starts = np.unique(at[x:y][np.isin(fp[x:y], fps)][:, None] - np.arange(window - k + 1))
                        starts = starts[starts >= first]
                        starts = starts[left[starts] >= window]
                    n, length = len(starts), length or window
                    yield _batch([[keys[a + d].as_py()] * n, starts - first, [length] * n, _joined_words(w, starts, length)], _PLACES)


def _count_words(texts: pa.Array) -> pa.Array:
    return pa.array([n for a, b in W.pieces(texts)
                     for n in W.word_table(texts.slice(a, b - a), W.LETTERS_LOWER).counts().tolist()], pa.int64())


def _by_joins(documents: DataFrame, items: DataFrame, text: str, into: str, window: int, k: int) -> DataFrame:
    """``find_contamination`` for a benchmark of any size."""
    held = staged(items.mapInArrow(partial(_item_rows, window=window, k=k), _ITEM_ROWS), "bench-windows")
    windows = held.filter("w is not null").select("len", "w", "i").distinct()
    short = sorted(r.len for r in held.filter(f"len between 1 and {window - 1}").select("len").distinct().collect())
    key = F.unhex(F.md5(F.col(text)))
    texts = documents.filter(F.length(text) > 0).select(key.alias("key"), F.col(text).alias("text"))
    seen = texts.mapInArrow(partial(_prints, window=window, k=k, short=short), _PRINTS)
    hits = seen.join(held.filter("fp is not null").select("len", "fp").distinct(), ["len", "fp"], "left_semi").distinct()
    hits = hits.groupBy("key").agg(F.collect_list(F.struct("len", "fp")).alias("prints"))
    # a text that stands often is looked at once
    near = texts.join(hits, "key").dropDuplicates(["key"]).select("key", "text", "prints")
    places = near.mapInArrow(partial(_places, window=window, k=k), _PLACES)
    places = staged(places.join(windows.select("len", "w").distinct(), ["len", "w"], "left_semi"), "bench-places")
    unite = F.arrow_udf(_annotated(_unite), "array<int>")
    spans = places.groupBy("key").agg(
        unite(F.flatten(F.collect_list(F.array("place", F.col("place") + F.col("len"))))).alias("_spans"))
    named = places.select("key", "len", "w").distinct().join(windows, ["len", "w"]).groupBy("key").agg(
        F.array_sort(F.collect_set("i")).alias("_items"))
    found = spans.join(named, "key").withColumnRenamed("key", "_of")
    count = F.arrow_udf(_annotated(_count_words, "texts"), "long")
    result = F.struct(count(F.col(text)).alias("n_words"),
                      F.coalesce("_spans", F.expr("cast(array() as array<int>)")).alias("spans"),
                      F.coalesce("_items", F.expr("cast(array() as array<string>)")).alias("items"))
    return documents.withColumn("_key", key).join(found, F.col("_key") == F.col("_of"), "left") \
        .withColumn(into, result).drop("_key", "_of", "_spans", "_items")


def _unite(spans: pa.Array) -> pa.Array:
    out = []
    for row in spans.to_pylist():
        merged = []
        for s, e in sorted(zip(row[::2], row[1::2])):
            if merged and s <= merged[-1]:
                merged[-1] = max(merged[-1], e)
            else:
                merged += [s, e]
        out.append(merged)
    return pa.array(out, pa.list_(pa.int32()))


def find_contamination(documents: DataFrame, benchmark: DataFrame, text: str = "text", into: str = "contamination",
                       window: int = WINDOW, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``documents`` with a struct column ``into``: n_words, spans (from, to, from, to, ... in
    words, merged) and items (the sorted ids of items with an occurring window)."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").alias("t")) \
        .filter(F.length("t") > 0)
    if (items.agg(F.sum(utf8_bytes(F.col("t")))).first()[0] or 0) > block_bytes:
        return _by_joins(documents, items, text, into, window, k)
    rows = items.collect()
    return documents.withColumn(into, _scanner([r.i for r in rows], [r.t for r in rows], window, k)(F.col(text)))


def _annotated(fn, argument: str = "spans"):
    fn.__annotations__ = {argument: pa.Array, "return": pa.Array}
    return fn


def hit_words(result) -> Column:
    """Words of a document inside occurring windows."""
    spans = result["spans"]
    pairs = F.sequence(F.lit(0), F.size(spans) - 2, F.lit(2))
    total = F.aggregate(pairs, F.lit(0).cast("long"),
                        lambda n, i: n + F.get(spans, i + 1) - F.get(spans, i))
    return F.when(F.size(spans) > 0, total).otherwise(F.lit(0).cast("long"))


def is_contaminated(result) -> Column:
    hit = hit_words(result)
    return (hit > 0) & (20 * hit >= result["n_words"])


def op5_decontamination(spark, sf_dir) -> DataFrame:
    """Digest of contamination for every document."""
    from quarry.llm.io import read

    found = find_contamination(read(spark, sf_dir, "documents").select("doc_id", "text"),
                               read(spark, sf_dir, "benchmark"))
    r = F.col("contamination")
    return found.select(
        "doc_id", r["n_words"].alias("n_words"), hit_words(r).alias("n_hit"),
        F.size(r["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(r["items"], ","), 256).alias("items_sha256"),
        is_contaminated(r).alias("contaminated"))
