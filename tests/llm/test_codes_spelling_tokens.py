"""Vector codes, spelling variants and token counts against brute force, through their registered queries
on small tables with awkward rows, and through their general interface."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import spelling, token_counts, vector_codes

public_tokenizers = pytest.importorskip("public_tokenizers")


def _folder(tmp_path, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


# ------------------------------------------------------------- vector codes
def _codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """vec_id -> (code, error) and the codebooks, by measuring everything in each round."""
    ids = sorted({r[0] for r in rows if r[0] is not None})[:entries]
    vec = [np.floor(scale * np.array(r[1], np.float64)).astype(np.int64).reshape(parts, -1) for r in rows]
    smallest = {i: min((tuple(r[1]), n) for n, r in enumerate(rows) if r[0] == i)[1] for i in ids}
    books = [[vec[smallest[i]][p].copy() for i in ids] for p in range(parts)]

    def nearest(p, x):
        return min((int(((x - e) ** 2).sum()), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        of = [[nearest(p, v[p])[1] for v in vec] for p in range(parts)]
        for p in range(parts):
            for k in range(len(ids)):
                mine = [v[p] for v, c in zip(vec, of[p]) if c == k]
                if mine:
                    books[p][k] = sum(mine) // len(mine)
    last = [[nearest(p, v[p]) for p in range(parts)] for v in vec]
    codes = [("".join("%02x" % k for _, k in x), sum(d for d, _ in x)) for x in last]
    digits = ",".join(str(int(c)) for p in books for e in p for c in e)
    return codes, hashlib.sha256(digits.encode()).hexdigest()


EMBEDDINGS = "vec_id long, embedding array<float>, label int, code string, error string, sums int"


def _vectors(n, seed=3, dims=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dims))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 5] + rng.normal(size=dims) * 0.4], None if i % 6 == 0 else i % 3)
            for i in range(n)]
    rows += [rows[7], rows[7], rows[3], (None, rows[5][1], 1), (900, rows[11][1], None), (901, [0.0] * dims, 2), (902, [-0.5] * dims, 2)]
    bad = [(903, None, 1), (904, [None] + [0.0] * (dims - 1), 1), (905, [float("nan")] * dims, 1), (906, [float("inf")] * dims, 0)]
    return rows, bad


@pytest.mark.parametrize("n", [150, 9])
def test_vector_codes(spark, tmp_path, n):
    rows, bad = _vectors(max(n, 12))
    rows = rows if n > 100 else rows[:n]
    table = spark.createDataFrame([(*r, "x", "y", 1) for r in rows + bad], EMBEDDINGS).repartition(5)
    got = sorted((tuple(r) for r in vector_codes.op11_vector_codes(spark, _folder(tmp_path, embeddings=table)).select(
        "vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)
    codes, digest = _codes(rows)
    by_label = Counter()
    for r, (_, e) in zip(rows, codes):
        by_label[r[2]] += e
    assert got == sorted(((r[0], c, e, by_label[r[2]], digest) for r, (c, e) in zip(rows, codes)), key=str)


def test_vector_codes_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([(1, None, 1, "", "", 1), (None, [0.5] * 16, 1, "", "", 1)], EMBEDDINGS)
    for table in (none.limit(0), none):
        assert vector_codes.op11_vector_codes(spark, _folder(tmp_path, embeddings=table)).collect() == []


def test_vector_codes_drops_other_lengths(spark):
    rows, _ = _vectors(40)
    odd = [(-1, [1.0] * 7, 1), (950, [1.0] * 8, 1), (951, [], 1)]
    one, books = vector_codes.train(spark.createDataFrame([(*r, "", "", 1) for r in rows + odd], EMBEDDINGS))
    two, other = vector_codes.train(spark.createDataFrame([(*r, "", "", 1) for r in rows], EMBEDDINGS))
    assert (books == other).all()
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_bounds_are_those_of_the_history():
    """Bounds hold for every entry after every round, and spare measurements."""
    rng = np.random.default_rng(1)
    v = rng.integers(-900, 900, size=(400, 2, 3))
    v[200:] += 4000
    history, state, spared = v[[0, 250, 3, 4]].transpose(1, 0, 2)[None].copy(), None, 0
    for _ in range(8):
        books = vector_codes.Books(history)
        state, scans = vector_codes.assign(books, v, state)
        spared += v.shape[0] * 2 - scans
        for p in range(2):
            d = np.sqrt(((v[:, p, None] - history[-1][p][None]) ** 2).sum(-1))
            assert (state["code"][:, p] == ((v[:, p, None] - history[-1][p][None]) ** 2).sum(-1).argmin(1)).all()
            own = d[np.arange(400), state["code"][:, p]]
            upper = state["upper"][:, p] + books.net[state["upper_at"][:, p], p, state["code"][:, p]]
            lower = state["lower"][:, p] - books.net_of_others[state["lower_at"][:, p], p, state["code"][:, p]]
            d[np.arange(400), state["code"][:, p]] = np.inf
            assert (upper >= own - 1e-6).all() and (lower <= d.min(1) + 1e-6).all()
        moved = np.stack([np.stack([v[state["code"][:, p] == k, p].sum(0) // max(1, (state["code"][:, p] == k).sum())
                                    if (state["code"][:, p] == k).any() else history[-1][p][k] for k in range(4)]) for p in range(2)])
        history = np.concatenate([history, moved[None]])
    assert spared > 0


# ------------------------------------------------------------- spelling variants
DOCS = "doc_id long, text string, word string, n long, prefix string, n_bytes int, at string, digest string, tokenizer string"


def _documents():
    rnd = random.Random(5)
    base = ["colour", "harbour", "naïveté", "façades", "kitchen", "kitchens", "kitten", "sitting", "aaaaaaa", "aaaaaaaa", "x" * 300]
    words = []
    for w in base:
        words += [w] * rnd.randint(20, 90)
        for _ in range(6):
            at, c = rnd.randrange(len(w)), rnd.choice("abcxyzéÿ×")
            words += [rnd.choice([w[:at] + w[at + 1:], w[:at] + c + w[at:], w[:at] + c + w[at + 1:], w.upper(), w.title()])] * rnd.randint(1, 9)
    rnd.shuffle(words)
    seps = [" ", "\n", "-", "9", "'", "ß ", "Ā", "ł", "\x00", "中"]
    rows = [(i, "".join(w + rnd.choice(seps) for w in words[i * 40:i * 40 + 60])) for i in range(len(words) // 40)]
    return rows + [(None, rows[0][1]), rows[1], rows[1], (500, None), (501, ""), (502, "  \n"), (503, "kitchen " * 20_000)]


def _variants(rows, noise=199):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % noise == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))

    close = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(close[w], key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 5 * n[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted(((w, form.get(w), root(w), n[w], len(close[w]), n.get(form.get(w))) for w in n), key=str)


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def test_spelling_variants(spark, tmp_path):
    rows = _documents()
    table = spark.createDataFrame([(*r, "w", 1, "p", 1, "a", "d", "t") for r in rows], DOCS).repartition(4)
    got = spelling.op12_spelling_variants(spark, _folder(tmp_path, documents=table)).select(*COLUMNS).collect()
    want = _variants(rows)
    assert sorted(map(tuple, got), key=str) == want
    assert sum(w[1] is not None for w in want) > 10 and any(w[1] is not None and w[1] != w[2] for w in want)


@pytest.mark.parametrize("block,groups", [(1, 12), (3, 2), (7, 5), (1000, 1)])
def test_spelling_blocks_and_groups_change_nothing(spark, block, groups):
    rows = _documents()
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = spelling.variant_groups(spelling.count_words(table, 6, 5, 199), block=block, groups=groups).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == _variants(rows)


def test_spelling_of_nothing(spark, tmp_path):
    table = spark.createDataFrame([(1, None, "w", 1, "p", 1, "a", "d", "t"), (2, "short a b", "w", 1, "p", 1, "a", "d", "t")], DOCS)
    for t in (table, table.limit(0)):
        assert spelling.op12_spelling_variants(spark, _folder(tmp_path, documents=t)).collect() == []


def test_words_are_given_back_in_parts(spark, monkeypatch):
    batches = spark.createDataFrame(_documents(), "doc_id long, text string").toArrow().to_batches(max_chunksize=3)
    whole = Counter()
    for b in spelling._count(iter(batches), 6, 199):
        whole.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist())))
    monkeypatch.setattr(spelling, "HELD", 4)
    parts = Counter()
    for b in spelling._count(iter(batches), 6, 199):
        parts.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist())))
    assert parts == whole and len(whole) > 20


# ------------------------------------------------------------- token counts
BPE = str(public_tokenizers.path("byte_bpe_50k.json"))
ODD = [" ", "  ", "\n", " \n", "\t", "a", "b'", "'s", "1", "<|endoftext|>", " <|endoftext|>", "<", "é", "\xa0", " ", "\x1c", "\x85",
       "中", "!", "!?", "don't", "​", "🙂", "ab12", "\r\n", "word", " word"]


def _library(path):
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        return lambda s: len(t.encode(s, add_special_tokens=False).ids)
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda s: len(m.encode(s))


def test_pieces_add_up_to_the_library_count():
    rnd, count, pieces = random.Random(1), _library(BPE), token_counts.Pieces(BPE)
    for _ in range(4000):
        s = "".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 14)))
        assert pieces(s) == count(s), repr(s)


def test_pieces_forgotten_between_texts_are_counted_again(monkeypatch):
    monkeypatch.setattr(token_counts, "PIECES", 3)
    count, pieces = _library(BPE), token_counts.Pieces(BPE)
    for s in ["so it goes on and on", "so it goes anew", "on and on", "it", " so it goes, on THAT!! and on", "and on THAT!! anew"]:
        assert pieces(s) == count(s), s
    rnd = random.Random(4)
    for _ in range(300):
        s = " ".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 14)))
        assert pieces(s) == count(s), repr(s)


def _token_rows():
    rnd = random.Random(2)
    rows = [(i, "".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 900)))) for i in range(40)]
    return rows + [(None, rows[3][1]), rows[4], rows[4], (50, rows[4][1]), (60, None), (61, ""), (62, "x" * 30_000), (63, "so it goes " * 30_000)]


def test_token_counts(spark, tmp_path):
    rows, count = _token_rows(), _library(BPE)
    table = spark.createDataFrame([(*r, "w", 1, "p", 1, "a", "d", "t") for r in rows], DOCS).repartition(4)
    got = token_counts.op13_token_counts(spark, _folder(tmp_path, documents=table)).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    want = [(d, len((t or "").encode()), count(t or ""), count(t or "") > 512) for d, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts.op13_token_counts(spark, _folder(tmp_path, documents=table.limit(0))).collect() == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_cache_encodes_only_distinct_misses(spark, name):
    path = str(public_tokenizers.path(name))
    count, cache, version = _library(path), token_counts.TokenCache(spark), token_counts.tokenizer_digest(path)
    rows = [r for r in _token_rows() if len(r[1] or "") < 5000]
    table = spark.createDataFrame([(*r, "w", 1, "p", 1, "a", "d", "t") for r in rows], DOCS)
    stored = lambda: spark.read.parquet(cache.path)
    half = table.filter("doc_id < 20")
    token_counts.count_tokens(half, path, cache)
    assert stored().count() == len({t or "" for d, t in rows if d is not None and d < 20})
    got = token_counts.count_tokens(table, path, cache)
    assert set(got.columns) == set(table.columns) - {"text"} | {"n_tokens"}
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got.collect()) == sorted(
        (str(d), len((t or "").encode()), count(t or "")) for d, t in rows)
    n = len({t or "" for _, t in rows})
    assert stored().count() == n and stored().select("digest").distinct().count() == n          # the first half was not encoded again
    token_counts.count_tokens(table, path, cache)
    assert stored().count() == n
    cache.append(stored().select("digest", "n_bytes", "n_tokens").limit(5), version)              # a second writer's rows
    assert token_counts.count_tokens(table, path, cache).count() == len(rows)


def test_another_tokenizer_version_takes_no_old_counts(spark, tmp_path):
    import json

    spec = json.load(open(BPE))
    spec["added_tokens"].append({"id": 50257, "content": "zebra", "single_word": False, "lstrip": False, "rstrip": False,
                                 "normalized": False, "special": True})
    other = str(tmp_path / "other.json")
    json.dump(spec, open(other, "w"))
    table = spark.createDataFrame([(1, "a zebrazebrazebra here")], "doc_id long, text string")
    cache = token_counts.TokenCache(spark)
    one = token_counts.count_tokens(table, BPE, cache).first().n_tokens
    two = token_counts.count_tokens(table, other, cache).first().n_tokens
    assert (one, two) == (_library(BPE)("a zebrazebrazebra here"), _library(other)("a zebrazebrazebra here")) and one != two


def test_normalised_contents_share_a_count(spark):
    table = spark.createDataFrame([(1, " same text"), (2, "same text "), (3, "other")], "doc_id long, text string")
    cache = token_counts.TokenCache(spark)
    got = token_counts.count_tokens(table, BPE, cache, normalise=F.trim).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {1: 2, 2: 2, 3: 1} and spark.read.parquet(cache.path).count() == 2
