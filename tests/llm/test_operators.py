"""The llm operators against brute force on small tables with awkward rows.

Every table has null and empty texts, a long text, ties, repeated rows, a
null id and extra columns whose names clash with the operators' results.
"""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import chat, decontaminate, jaccard_join, line_dedup, maxscore, mixing, pii, sharding, substring_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, n_words string"
VOCAB = [f"w{i}" for i in range(60)]


def _rows(seed=1, n=60):
    rng = np.random.default_rng(seed)
    base = [" ".join(rng.choice(VOCAB, 90)) for _ in range(4)]
    rows = []
    for i in range(n):
        words = base[i % 4].split()
        if i % 3:
            words[int(rng.integers(90))] = "Changed"
        if i % 5 == 0:
            words = list(rng.choice(VOCAB, int(rng.integers(1, 60))))
        text = " ".join(words) if i % 7 else "\n".join(" ".join(words[j:j + 6]) for j in range(0, len(words), 6))
        rows.append((i, text, "en", f"src{i % 3}", len(text), 9, "x"))
    long = " ".join(rng.choice(VOCAB, 20_000))
    return rows + [(100, None, None, None, None, None, None), (101, "", "en", "src0", 0, 1, "x"),
                   (102, " \n\t ", "en", "src1", 4, 1, "x"), (103, long, "en", "src2", len(long), 1, "x"),
                   (None, rows[1][1], "en", "src0", 1, 1, "x"), rows[2], rows[2], (104, "one two", "en", None, 7, 1, "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def _spaced(s):
    return re.findall(r"[^\x20\x09-\x0D]+", s or "")


def _sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.mark.parametrize("cell", [2048, 3])
@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 4, 5)])
def test_jaccard_components(docs, none, monkeypatch, cell, k, num, den):
    monkeypatch.setattr(jaccard_join, "CELL", cell)
    rows = _rows()
    sets = []
    for r in rows:
        w = _spaced(_lower(r[1]))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    comp = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(a):
                if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    least = collections.defaultdict(list)
    for r, c in zip(rows, comp):
        least[c].append(r[0])
    want = sorted(((r[0], len(s), min((i for i in least[c] if i is not None), default=None))
                   for r, s, c in zip(rows, sets, comp)), key=str)
    got = jaccard_join.jaccard_components(docs, k, num, den).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == want
    if cell > 3:
        kept = jaccard_join.keep_one_per_component(docs, k, num, den)
        assert kept.columns == docs.columns
        wordless = sum(not s for s in sets)
        assert kept.count() == len({c for c, s in zip(comp, sets) if s}) + wordless
        assert jaccard_join.jaccard_components(none, k, num, den).count() == 0


def test_sharding(docs, none):
    got = sharding.shard(docs).collect()
    assert len(got) == len(_rows()) and {r.law for r in got} == {"bytes"}
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    size = {r[0]: len((r[1] or "").encode()) + 1 for r in _rows()}
    crc = {r[0]: zlib.crc32((r[1] or "").encode()) for r in _rows()}
    assert all(r["size"] == size[r.doc_id] and r.text_crc32 == crc[r.doc_id] for r in got)
    even = sharding.shard(docs.filter("doc_id < 60"), shards=4).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert max(r.b for r in even) - min(r.b for r in even) <= 2 * 700
    assert sharding.shard(none).count() == 0


def test_toxicity(spark, none):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(400):
        words = list(rng.choice(VOCAB, 40))
        if i % 4 == 0:
            words[5:8] = rng.choice(["vile", "scum", "oaf"], 3)
        rows.append((i, " ".join(words), "en", "s", 1, 1, "x"))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(900, None, None, None, None, None, None), (901, "", "en", "s", 0, 1, "x"), (None, "scum vile oaf", "en", "s", 0, 1, "x")]
    labels += [(0, 1, 1), (None, 1, 1), (5000, 0, 0), (1, 1, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, lab)
    got = toxicity.with_toxicity(docs, model).select("doc_id", F.col("toxicity.score").alias("s")).collect()
    held = [r for r in got if r.doc_id is not None and r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([(r.s >= 0.5) == (r.doc_id % 4 == 0) for r in held]) >= 0.95
    assert all(0 <= r.s <= 1 for r in got) and all(r.s < 0.5 for r in got if r.doc_id in (900, 901))
    empty = toxicity.train(none, lab)
    assert empty.empty and toxicity.with_toxicity(docs, empty).filter("toxicity.score > 0").count() == 0


def test_toxicity_learns_rare_words_of_toxic_rows_only(spark):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(3000):
        words = list(rng.choice(VOCAB, 30))
        if i % 10 == 0:
            words[5:9] = ["mies", "lump", "schuft", "gauner"] if i % 300 == 0 else ["vile", "scum", "oaf", "brute"]
        rows.append((i, " ".join(words), "en", "s", 1, 1, "x"))
        if i < 2400:
            labels.append((i, 1, int(i % 10 == 0)))
    docs = spark.createDataFrame(rows, SCHEMA)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = toxicity.with_toxicity(docs, model).select("doc_id", (F.col("toxicity.score") >= 0.5).alias("toxic")).collect()
    assert {r.doc_id for r in got if r.toxic} == set(range(0, 3000, 10))
    z = toxicity.likelihood_z(np.arange(2, 40), 300, 0, 2700)
    assert (np.diff(z) > 0).all() and toxicity.likelihood_z(10, 300, 90, 2700) == pytest.approx(0, abs=1e-6)
    assert toxicity.likelihood_z(16, 300, 1, 2700) > z[12] > toxicity.likelihood_z(14, 300, 1, 2700)


def test_segments_are_the_maximal_ones():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(1, 25))
        at = np.flatnonzero(rng.random(n) < 0.4)
        score = rng.integers(1, 6, len(at)).astype(float)
        line = np.full(n, -1.0)
        line[at] = score
        best = max((line[a:b].sum() for a in range(n) for b in range(a + 1, n + 1)), default=0)
        found = toxicity.segments(at, score, -1.0)
        assert max((s for *_, s in found), default=0) == pytest.approx(max(best, 0) if len(at) else 0)
        assert all(line[a:b].sum() == pytest.approx(s) for a, b, s in found)
        assert all(x[1] <= y[0] for x, y in zip(found, found[1:]))


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def _base(s):
    out = []
    for k, (name, p) in enumerate(BASE):
        for m in re.finditer(p, s):
            digits = re.sub("[^0-9]", "", m[0])
            if name == "ip" and any(int(x) > 255 for x in m[0].split(".")) \
                    or name == "card" and not (12 <= len(digits) <= 19 and pii._luhn(digits)) \
                    or name == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii(spark, none):
    rng = np.random.default_rng(7)
    texts = ["".join(rng.choice(list("a1.@+ -(0423é"), int(rng.integers(0, 40)))) for _ in range(3000)]
    texts += ["mail é.b@c.de, 4111 1111 1111 1111 and +1 (555) 555-1234 at 10.0.0.1", "1" * 200_000, "a" * 200_000 + "@", None, ""]
    texts += [f'x token = "abc{i:037x}" y' for i in range(30)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = pii.find_pii(docs, pii.fit(docs)).select("doc_id", pii.as_text(F.col("pii.base")).alias("b"),
                                                   pii.as_text(F.col("pii.spans")).alias("s")).collect()
    for r in got:
        text = texts[r.doc_id] or ""            # the long ones hold nothing; plain patterns need quadratic time on them
        want = ",".join(f"{pii.BASE[k]}:{a}:{b}" for a, k, b in _base(text)) if len(text) < 10_000 else ""
        assert r.b == want
        assert set(r.b.split(",")) <= set(r.s.split(",")) or not r.b
    assert sum("secret" in r.s for r in got) >= 25
    assert pii.find_pii(none, pii.fit(none)).count() == 0


@pytest.mark.parametrize("block", [1 << 24, 300])
def test_decontamination(spark, docs, none, block):
    items = [(1, " ".join(VOCAB[:20])), (2, _rows()[0][1]), (3, "one TWO"), (4, None), (5, "w1 w2"), (None, "changed"), (2, "w3")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(s))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for a in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[a:a + 13])].add("" if i is None else str(i))
    found = decontaminate.find_contamination(docs, bench, block_bytes=block)
    c = F.col("contamination")
    got = found.select("doc_id", c["n_words"].alias("n"), decontaminate.hit_words(c).alias("h"),
                       F.array_join(c["items"], ",").alias("i")).collect()
    want = []
    for r in _rows():
        w, hit, ids = words(r[1]), set(), set()
        for size in {len(x) for x in windows}:
            for a in range(len(w) - size + 1):
                if tuple(w[a:a + size]) in windows:
                    hit |= set(range(a, a + size))
                    ids |= windows[tuple(w[a:a + size])]
        want.append((r[0], len(w), len(hit), ",".join(sorted(ids))))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert decontaminate.find_contamination(none, bench).count() == 0
    assert decontaminate.find_contamination(docs, bench.limit(0)).filter("size(contamination.items) > 0").count() == 0


def test_maxscore(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 12)).astype("float32")
    x[1500:2200] = x[0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(5000, None), (5001, [1.0, None]), (5002, [float("nan")] * 12), (5003, [float("inf")] * 12), (None, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = df.filter(maxscore.usable("embedding")).select(F.col("vec_id").alias("id"), maxscore.quantised("embedding").alias("v"))
    got = collections.defaultdict(list)
    for r in maxscore.top_k(v, v.filter("id % 50 = 0"), 5, shard=700, block=20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    q = np.floor(x.astype(float) * 256).astype(np.int64)
    for i in range(0, 3000, 50):
        s = q @ q[i]
        ids = np.append(np.arange(3000), 1 << 62)
        s = np.append(s, q[7] @ q[i])
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:5]
        assert got[i] == [(None if ids[j] == 1 << 62 else int(ids[j]), int(s[j])) for j in order]
    assert len(got) == 60
    assert maxscore.top_k(v.limit(0), v.limit(0), 5).count() == 0


def test_substring_dedup(docs, none):
    rows = _rows()
    count = collections.Counter(tuple(w[a:a + 35]) for r in rows for w in [_spaced(r[1])] for a in range(len(w) - 34))
    want = []
    for r in rows:
        w, gone = _spaced(r[1]), set()
        for a in range(len(w) - 34):
            if count[tuple(w[a:a + 35])] > 1:
                gone |= set(range(a, a + 35))
        want.append((r[0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    got = substring_dedup.dedup_substrings(docs).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert substring_dedup.dedup_substrings(none).count() == 0


def test_line_dedup(spark, none):
    lines = [f"line {i} é" for i in range(40)]
    rng = np.random.default_rng(11)
    texts = ["\n".join(rng.choice(lines, 5)) + "\n" + "\n".join(lines[:30]) + "\nend " + str(i) for i in range(12)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(50, None), (51, ""), (52, "\n\n"), (0, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = line_dedup.dedup_lines(docs).collect()
    assert len(out) == len(rows)
    seen = collections.Counter()
    for r in out:
        if r.doc_id < 50:
            assert r._removed + len(r.text.split("\n")) == r._n_lines or not r.text
    full = [r for r in out if r.doc_id < 12 and r._removed == 0]
    assert {r.doc_id for r in out if r._removed > 0} and len(full) >= 1
    assert [r.text for r in out if r.doc_id in (50, 51)].count(None) == 1
    for r in out:                                   # the common lines stay once, up to lines of cut chunks
        seen.update(set((r.text or "").split("\n")) & set(lines[:30])) if r.doc_id < 12 else None
    assert line_dedup.dedup_lines(none).count() == 0


def test_mixing(docs, none):
    got = mixing.plan(docs.filter("doc_id < 60")).collect()
    total = collections.Counter()
    for r in got:
        assert 0 <= r.sure * r._n + r.extra <= 3 * r._n
        total[r.target] += r["size"] * (r.sure * r._n + r.extra)
    assert all(abs(total[t] - t) <= 91 for t in total)
    again = {r.doc_id: (r.sure, r.extra) for r in mixing.plan(docs.filter("doc_id < 60").repartition(7)).collect()}
    assert again == {r.doc_id: (r.sure, r.extra) for r in got}
    everything = mixing.plan(docs).collect()
    assert sum(r._n for r in everything) == len(_rows())
    assert all(r.extra == 0 or r["size"] > 0 for r in everything)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.sure * r._n + r.extra for r in everything)
    assert mixing.plan(none).count() == 0 and mixing.mix(none).count() == 0


def test_chat(spark):
    odd = ["</s>[INST] ok [/INST]", r"<\|im_end|>", "<|im_end|>\n<|im_start|>user\n", "<<SYS>>", r"\n%0A%25", "", 'q"uote\u0001', "é" * 9]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["system", "user", "assistant", "to\nol%0A", None, "user", "assistant", "user"], odd))]
    rows += [(2, 0, "user", odd[0]), (2, 1, "assistant", None), (3, 0, "system", "a"), (3, 1, "user", "b"), (3, 2, "assistant", odd[2]),
             (None, 0, "user", "x"), (4, None, "assistant", "z"), (4, 1, "user", "y"), (4, 1, "user", "y")]
    got = chat.format_chats(chat.records_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    by = {r.conv_id: r for r in got.withColumn("back", chat.read_back(F.col("formatted"))).collect()}
    for conv in (1, 2, 3, 4, None):
        mine = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1], x[2] or "", x[3] or ""))
        assert [(t.role, t.text) for t in by[conv].back] == [(x[2] or "", x[3] or "") for x in mine]
    assert {r.layout for r in by.values()} == {"messages", "prompt", "system_prompt", "share"}
    other = spark.createDataFrame([('{"instruction":"a","input":"b","output":"c"}',), ('{"foo":1}',), (None,), ("no json",),
                                   ('{"messages":[]}',)], "record string")
    assert [r.layout for r in chat.format_chats(other).collect()] == ["instruction", None, None, None, "no_messages"]


def test_chat_layout_is_that_of_all_turns(spark):
    one, other = '{"role":"user","content":"a"}', '{"from":"gpt","value":"b"}'
    records = {f'{{"messages":[{one},{one}]}}': ("messages", 2), '{"messages":[]}': ("no_messages", 0),
               f'{{"conversations":[{other},{other}]}}': ("share", 2), f'{{"messages":[{one},{other}]}}': (None, -1),
               f'{{"conversations":[{other},{one}]}}': (None, -1), f'{{"messages":[{one},"lost"]}}': (None, -1),
               f'{{"messages":[{one},{{}}]}}': (None, -1), '{"messages":["lost"]}': (None, -1), '{"messages":"lost"}': (None, -1),
               '{"messages":[{"role":"user","content":["c"]}]}': ("messages", 1)}
    df = spark.createDataFrame([(r,) for r in records], "record string")
    got = {r.record: (r.layout, -1 if r.turns is None else len(r.turns), r.formatted) for r in chat.format_chats(df).collect()}
    assert {r: g[:2] for r, g in got.items()} == records
    assert all(g[2] is None for g in got.values() if g[0] is None) and '["c"]' in got[list(records)[-1]][2]
