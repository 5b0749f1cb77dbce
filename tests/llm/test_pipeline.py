"""corpus_pipeline: every stage against brute force on its own input, and the whole run."""

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from quarry.llm import toxicity as tx

DOCS = "doc_id long, text string, lang string, source string, n_chars long, toxicity string, shard string, _key int"
VOCAB = [f"w{i}" for i in range(300)]


def _rows(seed=1):
    rng = np.random.default_rng(seed)
    text = lambda n: " ".join(rng.choice(VOCAB, n))
    rows = []
    for i in range(420):
        t = text(int(rng.integers(15, 90)))
        if i % 18 == 1:
            t += " " + " ".join(rng.choice(["vile", "foul", "nasty"], 12))
        rows.append((i, t))
    rows += [(600 + i, rows[i * 2][1]) for i in range(12)]                              # exact copies
    rows += [(700 + i, rows[i * 3][1] + " " + "Tail") for i in range(12)]               # near copies
    bench = [("b0", text(30)), ("b1", text(16)), ("b2", "short item here"), ("b3", None), (None, ""), ("b0", text(20))]
    rows += [(800 + i, text(20) + " " + bench[i % 2][1] + " " + text(20)) for i in range(6)]
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, text(5_000)), (None, text(40)), rows[3], rows[3], (904, "one two"), (905, "one two")]
    full = [(i, t, "en", [None, "s0", "s1", "s2"][k % 4], 1, "x", "y", 1) for k, (i, t) in enumerate(rows)]
    labels = [(i, 1, int("vile" in t or "foul" in t or "nasty" in t)) for i, t in rows if i is not None and i < 420] + [(None, 1, 1), (999, 0, None)]
    return full, labels, bench


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("pipeline"))
    docs, labels, bench = _rows()
    for name, rows, schema in (("documents", docs, DOCS), ("labels", labels, "doc_id long, quality int, toxic int"),
                               ("benchmark", bench, "item_id string, text string")):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{where}/{name}.parquet")
    return where


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def _as_bag(df):
    return collections.Counter(tuple(r) for r in df.collect())


def test_toxicity_stage_rejects_what_scores(spark, docs, folder):
    kept = cp.toxicity(spark, docs, folder)
    assert kept.columns == docs.columns
    model = tx.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scored = tx.with_toxicity(docs, model, into="_t")
    assert _as_bag(kept) == _as_bag(scored.filter(F.col("_t.score") < 0.5).select(*docs.columns))
    left = kept.collect()
    bad = lambda t: len(re.findall("vile|foul|nasty", t or "")) > 3
    assert not any(bad(r.text) for r in left)                                          # planted ones go
    assert len(left) == sum(not bad(r.text) for r in docs.collect())                   # clean ones stay


def _set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_near_copies_stage_keeps_one_of_each_group(spark, docs, folder):
    kept = cp.near_copies(spark, docs, folder)
    assert kept.columns == docs.columns
    rows = [tuple(r) for r in docs.collect()]
    sets = [_set(r[1]) for r in rows]
    comp = list(range(len(rows)))

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                comp[max(top(a), top(b))] = min(top(a), top(b))
    groups = collections.defaultdict(list)
    for i, r in enumerate(rows):
        groups[top(i) if sets[i] else ("alone", i)].append(r)
    got = _as_bag(kept)
    assert sum(got.values()) == len(groups)
    least = collections.Counter(min((r[0] for r in g if r[0] is not None), default=None) for g in groups.values())
    assert collections.Counter(r[0] for r in got.elements()) == least


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_decontaminate_stage(spark, docs, folder):
    items = [_words(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    wins = collections.defaultdict(set)
    for w in items:
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wins[n].add(tuple(w[i:i + n]))

    def clean(text):
        w = _words(text)
        hit = np.zeros(len(w), bool)
        for n, some in wins.items():
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in some:
                    hit[i:i + n] = True
        return not (hit.sum() > 0 and 20 * hit.sum() >= len(w))
    want = collections.Counter(tuple(r) for r in docs.collect() if clean(r.text))
    kept = cp.decontaminate(spark, docs, folder)
    assert kept.columns == docs.columns and _as_bag(kept) == want
    assert sum(want.values()) == docs.count() - 6


def test_mix_stage(spark, docs, folder):
    mixed = cp.mix(spark, docs, folder)
    assert mixed.columns == docs.columns
    given, got = _as_bag(docs), _as_bag(mixed)
    assert set(got) <= set(given) and all(got[r] <= 3 * given[r] for r in got)
    size = lambda bag, s: sum(n * len((r[1] or "").split()) for r, n in bag.items() if r[3] == s)
    sources = sorted({r[3] for r in given if r[3]}) + [None]
    total, weight = sum(size(given, s) for s in sources), dict(zip(sources, [5, 2, 1, 5]))
    target, free, left = {}, list(sources), total
    while free:                                          # targets stop at three times a source's size
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * size(given, s)]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * size(given, s)
            left -= target[s]
            free.remove(s)
    largest = max(len((r[1] or "").split()) for r in given)
    assert all(abs(size(got, s) - target[s]) <= largest for s in sources)
    assert _as_bag(cp.mix(spark, docs, folder)) == got                                  # reruns agree


def test_shard_stage(spark, docs, folder):
    rows = cp.shard(spark, docs, folder).collect()
    given = docs.collect()
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(r.doc_id for r in given)
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_run_chains_the_stages(spark, folder):
    kept = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in cp.STAGES[:3]:
        kept = stage(spark, kept, folder)
    kept_ids = {r.doc_id for r in kept.collect()}
    got = cp.run(spark, folder).collect()
    assert {r.doc_id for r in got} <= kept_ids and len({r.doc_id for r in got}) > 50
    assert sum(r["size"] for r in got) > 0 and [n for n, _ in cp.STAGES] == ["toxicity", "near_copies", "decontaminate", "mix", "shard"]


def test_empty_tables_pass_through(spark, folder, docs, tmp_path):
    none = docs.limit(0)
    for name, stage in cp.STAGES:
        assert stage(spark, none, folder).count() == 0
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.toxicity(spark, docs, str(tmp_path)).count() == docs.count()
    assert cp.decontaminate(spark, docs, str(tmp_path)).count() == docs.count()


def test_a_task_leaves_its_worker_small():
    """What a task freed goes back to the system, also when the task is not read to its end: idle workers kept their peaks."""
    import os

    from quarry.llm import jaccard_join as jj
    from quarry.llm.io import gives_back

    def held():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20

    kept = []

    @gives_back
    def task(batches):
        for n in batches:
            blocks = [bytearray(60_000) for _ in range(n)]        # too small to be mapped one by one
            kept.append(bytearray(60_000))                        # lies above them, so the heap's end can't fall
            yield len(blocks)
            del blocks

    before = held()
    assert list(task([4000])) == [4000]
    assert held() - before < 100                                  # of 229 MB
    half = task([4000, 1])
    assert next(half) == 4000
    half.close()
    assert held() - before < 100
    assert all(hasattr(f, "__wrapped__") for f in (jj._describe, jj._postings, jj._cells, jj._shingles))
