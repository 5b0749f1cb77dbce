"""Cases that once went wrong: long and repetitive texts, clashing names, groups at a shard's end, added spans."""

import collections
import hashlib
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import decontaminate, line_dedup, pii, sharding, toxicity


def _maximal(line):
    """All maximal scoring segments by their definition (Ruzzo and Tompa): the best segment, then the same on both sides."""
    best = None
    for a in range(len(line)):
        for b in range(a + 1, len(line) + 1):
            s = line[a:b].sum()
            if s > 1e-9 and (best is None or s > best[0] + 1e-9 or abs(s - best[0]) <= 1e-9 and b - a < best[2] - best[1]):
                best = (s, a, b)
    if best is None:
        return []
    s, a, b = best
    return _maximal(line[:a]) + [(a, b, s)] + [(a2 + b, b2 + b, s2) for a2, b2, s2 in _maximal(line[b:])]


def test_all_maximal_segments():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 26))
        at = np.flatnonzero(rng.random(n) < 0.45)
        score = rng.random(len(at)) * 5 + 0.1              # no ties
        line = np.full(n, -1.0)
        line[at] = score
        got = [(a, b, round(s, 6)) for a, b, s in toxicity.segments(at, score, -1.0)]
        assert got == [(a, b, round(float(s), 6)) for a, b, s in _maximal(line)]


def test_segments_take_linear_time():
    def seconds(n):
        at, t = np.arange(n) * 100, time.perf_counter()
        assert len(toxicity.segments(at, np.full(n, 3.0), -0.1)) == n
        return time.perf_counter() - t
    few, many = min(seconds(10_000) for _ in range(3)), seconds(100_000)
    assert many < 0.1 + 15 * few


def _hit(doc, items, window=13):
    """(hit words, items with a window in it) of a list of words."""
    hit, names = np.zeros(len(doc), bool), set()
    for name, words in items:
        n = min(window, len(words))
        if n:
            wins = {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}
            for i in range(len(doc) - n + 1):
                if tuple(doc[i:i + n]) in wins:
                    hit[i:i + n] = True
                    names.add(name)
    return hit, names


@pytest.mark.parametrize("seed", range(4))
def test_contamination_of_repetitive_texts(seed):
    rng = np.random.default_rng(seed)
    words = lambda n, v: [f"w{x}" for x in rng.integers(0, v, n)]
    items = [(f"i{i}", words(int(rng.integers(0, 40)), 2)) for i in range(6)] + [("na", ["na"] * 30), ("nb", ["na"] * 5 + ["b"]), ("i0", ["x"] * 3)]
    docs = [words(int(rng.integers(0, 120)), 2) for _ in range(8)] + [["na"] * 60, ["x", "x", "x", "y"] * 5, []]
    index = decontaminate._Items([n for n, _ in items], [" ".join(w) for _, w in items], 13, 7)
    for doc, (n, spans, names) in zip(docs, decontaminate._scan(pa.array([" ".join(d) for d in docs]), index, 13, 7)):
        hit, want = _hit(doc, items)
        got = np.zeros(len(doc), bool)
        for a, b in zip(spans[::2], spans[1::2]):
            got[a:b] = True
        assert n == len(doc) and (got == hit).all() and names == want


def test_long_repetitions_take_seconds():
    t = time.perf_counter()
    index = decontaminate._Items(["a"], ["na " * 2_000], 13, 7)
    ((n, spans, names),) = decontaminate._scan(pa.array(["na " * 200_000]), index, 13, 7)
    assert (n, spans, names) == (200_000, [0, 200_000], {"a"}) and time.perf_counter() - t < 20


def test_line_dedup_keeps_columns_of_any_name(spark):
    block = "\n".join(f"common line {i}" for i in range(40))
    rows = [(i, f"own {i}\n{block}\nend {i}", "c", "l", "t") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, chunks string, lines string, t string")
    out = line_dedup.dedup_lines(docs).collect()
    assert len(out) == 6 and all((r.chunks, r.lines, r.t) == ("c", "l", "t") for r in out)
    assert sum(r._removed > 0 for r in out) == 5


def test_small_groups_lie_in_one_shard(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 99, int(rng.integers(20, 60)))) for _ in range(150)]
    rows = [(i, texts[int(rng.integers(150))]) for i in range(1500)] + [(2000 + i, "hot " * 50) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for shards in (16, 5):
        got = sharding.shard(docs, shards=shards).collect()
        of, size = collections.defaultdict(set), collections.Counter()
        text = dict(rows)
        for r in got:
            of[text[r.doc_id]].add(r.shard)
            size[r.shard] += r["size"]
        total = sum(size.values())
        weight = collections.Counter()
        for i, t in rows:
            weight[t] += len(t.encode()) + 1
        assert all(len(s) == 1 for t, s in of.items() if weight[t] <= 0.1 * total / shards)
        assert len(of["hot " * 50]) > 1                                  # a group above a shard is cut
        assert max(size.values()) - min(size.values()) <= 0.25 * total / shards
        slots = collections.defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def _spans(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.s for r in pii.find_pii(docs, pii.fit(docs)).select("doc_id", pii.as_text(F.col("pii.spans")).alias("s")).collect()}


@pytest.mark.parametrize("times", [1, 40])
def test_added_spans_are_alike_at_every_size(spark, times):
    """Tokens that two labelers vote for are added; digit runs that only fail the check digit never are,
    however many base spans stand beside them."""
    texts = [f'x token = "{hashlib.sha1(bytes([i])).hexdigest()}" y' for i in range(6)] + [f"order 98071576280449{i:02d} of mail{i}@a.de at 10.0.0.{i}" for i in range(20)]
    texts += ["call (826) 555-4081 now", "see 555 555-0123", "token your-api-key-changeme-123456 x", "4012 8888 8888 1881", None, ""]
    got = _spans(spark, texts * times)
    for i, t in enumerate(texts * times):
        s = got[i]
        if t and t.startswith("x token"):
            assert "secret" in s
        if t and t.startswith("order"):
            assert "number" not in s and "email" in s
    assert "tel" in got[texts.index("call (826) 555-4081 now")]
    assert got[texts.index("see 555 555-0123")] == ""
    assert pii.fit(spark.createDataFrame([(1, "no candidates")], "doc_id long, text string")) is None
