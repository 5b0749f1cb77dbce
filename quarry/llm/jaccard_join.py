"""N-gram Jaccard self-join, size aware, and the components of its links.

A text's set holds its distinct k-word shingles (64-bit hashes; all its words
as one shingle if it has fewer).  Two sets link when den * |both| >= num *
|either|.  Equal sets are one set from the start.

Candidates come two ways, and the size boundary between them is chosen by
the cost both would have on the sizes counted:

* light (small) sets enumerate their subsets: linked light sets share the
  subset both keep when each drops at most n - ceil(J n) shingles;
* heavy (large) sets scan inverted lists of prefixes: in a common order of
  shingles, linked sets share one of their first n - ceil(J n) + 1.

The order puts shingles that tasks saw again last, by count (at most
``MAX_FREQUENT`` are told apart; any order is correct), then goes by hash.

Lists are worked on in cells of about ``CELL`` sets.  A pair must pass two
exact-safe tests: sizes, and the Hamming distance of parity maps, which never
exceeds the symmetric difference.  A map has 256 to 1024 bits, and more for
sets so long that unrelated ones would pass (see ``map_bits``).  All pairs of a large group of
copies are never written out: round one keeps, per set and list, one link to
an earlier set (or, without any, to a later one), verifies them on the shingles and forms components; round two
verifies *every* remaining passing pair whose sets are still in different
components.  What is left out joins sets already joined, so the components
are those of all links.  Sets that share several lists are a pair in the first
of them, by key, and in few others: every row carries its set's ``BEFORE`` keys
before this one, and a pair that has one of them in common met there already
(its first common list has none, so no pair is lost).  A list longer than a cell is split: round one adds
its smallest set to every cell, round two crosses the sets outside the
list's main component with all cells.

Defined cases: a null text or one without words has the empty set and links
with nothing; a null doc_id takes part, and components ignore it unless they
hold no other; equal rows are one set; an empty table gives no rows.  Sets and
shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import words as W
from quarry.llm.io import gives_back, staged

MAX_FREQUENT, GATHER, CELL, PAIRS, LIGHT_MOST, DROPS, BEFORE = 500_000, 1 << 22, 2048, 1 << 16, 64, 3, 3
_BEFORE = [f"before{d}" for d in range(1, BEFORE + 1)]
_SETS = "row long, text_key long, doc_id long, sid long, n long, bits binary, shingle long, seen long"


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, shingle) of the distinct shingles, sorted by both, and their number per text."""
    w = W.word_table(texts, W.SPACED_LOWER)
    n, left, owner = w.counts(), w.left(), w.owner()
    g = W.ngrams(w.hash, k)
    at = np.flatnonzero(left[:len(g)] >= k)
    own, hashes = [owner[at]], [g[at]]
    for length in range(1, k):
        texts_of = np.flatnonzero(n == length)
        own.append(texts_of)
        hashes.append(W.ngrams(w.hash, length)[w.first[texts_of]] if len(texts_of) else g[:0])
    own, hashes = np.concatenate(own), np.concatenate(hashes)
    order = np.lexsort((hashes, own))
    own, hashes = own[order], hashes[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (hashes[1:] != hashes[:-1])
    own, hashes = own[new], hashes[new]
    return own, hashes, np.bincount(own, minlength=len(w))


def _sums(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
    return c[first[1:]] - c[first[:-1]]


def _set_ids(first, hashes):
    return W.mix(_sums(first, W.mix(hashes, 11)), 12)


def map_bits(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Bits of the parity map of sets of n, a power of two: unrelated sets differ in half the bits,
    which must lie clear of the difference that links may have, 2 n (den - num) / (den + num)."""
    least = np.maximum(np.clip(4 * n, 256, 1024), 5 * n * (den - num) // (den + num))
    return 1 << np.ceil(np.log2(least)).astype(np.int64)


def _parity_maps(own, hashes, size) -> tuple[np.ndarray, np.ndarray]:
    """(words, first): per set of ``size`` bits the parity of the shingles that fall on each, as uint64 words."""
    base = np.concatenate([[0], np.cumsum(size)])
    at = base[own] + (W.mix(hashes, 13) & (size[own] - 1).astype(np.uint64)).astype(np.int64)
    bits = np.packbits((np.bincount(at, minlength=base[-1]) & 1).astype(np.uint8), bitorder="little")
    return bits.view(np.uint64), base // 64


def _long(a) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64) if a.dtype == np.uint64 else a.astype(np.int64))


@gives_back
def _describe(batches, k, num, den):
    """One row per text (sid, n, bits), and the shingles that a task sees again (shingle, seen)."""
    gathered, held = [], 0
    for batch in batches:
        texts = W.text_column(batch, "text")
        for a, b in W.pieces(texts):
            own, h, n = shingle_sets(texts.slice(a, b - a), k)
            first = np.concatenate([[0], np.cumsum(n)])
            bits, at = _parity_maps(own, h, map_bits(n, num, den))
            ids = [W.text_column(batch, c).slice(a, b - a) for c in ("row", "text_key", "doc_id")]
            yield _columns(*ids, _long(_set_ids(first, h)), pa.array(n.astype(np.int64)),
                           _binaries(bits, at), None, None)
            gathered.append(h)
            held += len(h)
            if held >= GATHER:
                yield _seen_again(gathered)
                held = 0
    if held:
        yield _seen_again(gathered)


def _binaries(words: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first) - 1, [
        None, pa.py_buffer((first * 8).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(words))]).cast(pa.binary())


def _seen_again(gathered) -> pa.RecordBatch:
    """Hashes that stand at least twice, with their numbers; sorted in place, as this is a task's largest array."""
    h = np.concatenate(gathered)
    gathered.clear()
    h.sort()
    same = np.zeros(len(h) + 1, bool)                # same[i]: h[i] equals h[i - 1]
    np.equal(h[1:], h[:-1], out=same[1:-1])
    first = np.flatnonzero(~same[:-1] & same[1:])
    last = np.flatnonzero(same[:-1] & ~same[1:])
    return _columns(None, None, None, None, None, None, _long(h[first]), _long(last - first + 1))


def _columns(*columns) -> pa.RecordBatch:
    """A batch of the ``_SETS`` columns; what is None is null."""
    rows = next(len(c) for c in columns if c is not None)
    names = [x.split()[0] for x in _SETS.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.nulls(rows, pa.binary() if name == "bits" else pa.int64()) if c is None else c
         for name, c in zip(names, columns)], names)


def _need(n, num, den):
    """Least overlap a set of n must have with any partner: ceil(J n)."""
    return (num * n + den - 1) // den


def _subset_count(n: int, num: int, den: int) -> float:
    drops = n - int(_need(n, num, den))
    return math.inf if drops > DROPS else sum(math.comb(n, d) for d in range(drops + 1))


def choose_boundary(sizes: dict, num: int, den: int) -> int:
    """Sets smaller than this enumerate subsets; chosen by the postings both ways would write and verify."""
    best = (math.inf, 1)
    for bound in range(1, LIGHT_MOST + 1):
        light = sum(c * _subset_count(n, num, den) for n, c in sizes.items() if n < bound)
        heavy = sum(c * (2 * (n - int(_need(n, num, den)) + 1) + n / 8) for n, c in sizes.items()
                    if n >= _need(bound, num, den))
        best = min(best, (light + heavy, bound))
    return best[1]


def _subset_keys(h: np.ndarray, drops: int) -> np.ndarray:
    """Keys of all subsets of ``h`` missing at most ``drops`` shingles."""
    v = W.mix(h, 21)
    level = [(v.sum(dtype=np.uint64), -1)]
    out = [(level[0][0], len(h))]
    for d in range(1, drops + 1):
        level = [(s - v[j], j) for s, last in level for j in range(last + 1, len(v))]
        out += [(s, len(h) - d) for s, _ in level]
    return W.mix(np.array([s for s, _ in out], np.uint64) + np.array([m for _, m in out], np.uint64), 22)


@gives_back
def _postings(batches, k, num, den, boundary, frequent, counts):
    """(key, sid, n) of subset keys and prefix lists."""
    with np.errstate(over="ignore"):
        for batch in batches:
            texts = W.text_column(batch, "text")
            for a, b in W.pieces(texts):
                own, h, n = shingle_sets(texts.slice(a, b - a), k)
                first = np.concatenate([[0], np.cumsum(n)])
                sid = _set_ids(first, h)
                once = np.zeros(b - a, bool)                   # equal sets of a piece post once
                once[np.unique(sid, return_index=True)[1]] = True
                once &= n > 0
                i = np.minimum(np.searchsorted(frequent, h), max(0, len(frequent) - 1))
                rank = np.where(frequent[i] == h, counts[i], 0) if len(frequent) else np.zeros(len(h), np.int64)
                order = np.lexsort((h, rank, own))
                place = np.arange(len(h)) - first[own[order]]
                o = own[order]
                take = once[o] & (place < (n - _need(n, num, den) + 1)[o]) & (n >= _need(boundary, num, den))[o]
                keys, owners = [W.mix(h[order][take], 23)], [o[take]]
                for d in np.flatnonzero(once & (n < boundary)):
                    s = _subset_keys(h[first[d]:first[d + 1]], int(n[d] - _need(n[d], num, den)))
                    keys.append(s)
                    owners.append(np.full(len(s), d))
                o = np.concatenate(owners)
                yield pa.RecordBatch.from_arrays([_long(np.concatenate(keys)), _long(sid[o]), _long(n[o])], ["key", "sid", "n"])


def _pairs_of(sizes: np.ndarray):
    """Index pairs (earlier, later) inside consecutive groups of these sizes, in bounded chunks."""
    start = np.concatenate([[0], np.cumsum(sizes)])
    later = np.arange(start[-1])
    n_before = later - np.repeat(start[:-1], sizes)
    upto = np.concatenate([[0], np.cumsum(n_before)])
    at = 0
    while at < len(later):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + PAIRS, "right")) - 1)
        c = n_before[at:end]
        j = np.repeat(later[at:end], c)
        i = np.repeat(later[at:end] - c, c) + np.arange(len(j)) - np.repeat(np.cumsum(c) - c, c)
        yield i, j
        at = end


@dataclass
class Maps:
    """Parity maps of some rows: uint64 words and where each row's begin."""

    words: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> "Maps":
        column = column.cast(pa.large_binary())
        at = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
        raw = np.frombuffer(column.buffers()[2], np.uint8)[at[0]:at[-1]]
        return cls(np.frombuffer(raw.tobytes(), np.uint64), (at - at[0]) // 8)

    def folded(self, rows: np.ndarray, m: int) -> np.ndarray:
        """(rows, m) words: the maps folded to m words each (m is a power of two, not above any row's own)."""
        size = self.first[rows + 1] - self.first[rows]
        out = np.empty((len(rows), m), np.uint64)
        for w in np.unique(size):
            mine = np.flatnonzero(size == w)
            x = self.words[self.first[rows[mine]][:, None] + np.arange(w)]
            out[mine] = np.bitwise_xor.reduce(x.reshape(len(mine), w // m, m), axis=1)
        return out


def _passing(sid, n, maps: Maps, short, i, j, num, den):
    """Pairs that pass the tests; ``short`` holds all maps folded to 4 words, tried before the whole maps."""
    a, b = n[i], n[j]
    ok = (sid[i] != sid[j]) & (den * np.minimum(a, b) >= num * np.maximum(a, b))
    i, j, a, b = i[ok], j[ok], a[ok], b[ok]
    most = a + b - 2 * ((num * (a + b) + num + den - 1) // (num + den))
    ok = np.bitwise_count(short[i] ^ short[j]).sum(axis=1) <= most
    i, j, most = i[ok], j[ok], most[ok]
    size = maps.first[1:] - maps.first[:-1]
    common = np.minimum(size[i], size[j])
    ok = common <= 4
    for m in np.unique(common[~ok]):
        of = np.flatnonzero(common == m)
        step = max(1, PAIRS // int(m))
        for at in range(0, len(of), step):
            p = of[at:at + step]
            apart = np.bitwise_count(maps.folded(i[p], int(m)) ^ maps.folded(j[p], int(m))).sum(axis=1)
            ok[p] = apart <= most[p]
    return i[ok], j[ok]


def _met_before(before, i, j):
    """Pairs that share one of the keys before this one."""
    met = np.zeros(len(i), bool)
    for x in before:
        for y in before:
            met |= x[i] == y[j]
    return met


@gives_back
def _cells(batches, num, den, first_round):
    """Candidate pairs of sorted cells; a cell may go over batches, so its tail waits for the next."""
    names = ["cell", "sid", "n", "comp"]
    wait = None
    for batch in _with_end(batches):
        rows, wait = wait, None
        if batch is not None:
            rows = pa.Table.from_batches([batch]) if rows is None else pa.concat_tables([rows, pa.Table.from_batches([batch])])
            cell = rows["cell"].to_numpy()
            same = np.flatnonzero(cell != cell[-1]) if len(cell) else []
            cut = int(same[-1]) + 1 if len(same) else 0
            rows, wait = rows.slice(0, cut), rows.slice(cut)
        if rows is None or not len(rows):
            continue
        rows = rows.combine_chunks()
        cell, sid, n, comp = (rows[c].to_numpy().astype(np.int64) for c in names)
        before = [rows[c].to_numpy() for c in _BEFORE]
        maps = Maps.of(rows["bits"].combine_chunks())
        short = maps.folded(np.arange(len(n)), 4)
        found = []
        at = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
        for i, j in _pairs_of(np.diff(at)):
            if not first_round:
                keep = comp[i] != comp[j]
                i, j = i[keep], j[keep]
            i, j = _passing(sid, n, maps, short, i, j, num, den)
            new = ~_met_before(before, i, j)
            i, j = i[new], j[new]
            if first_round and len(j):      # one earlier partner each, or a later one for sets that have none: all are named
                early = np.unique(j, return_index=True)[1]
                first, late = np.unique(i, return_index=True)
                at = np.union1d(early, late[~np.isin(first, j)])
                i, j = i[at], j[at]
            found.append(np.stack([np.minimum(sid[i], sid[j]), np.maximum(sid[i], sid[j])], 1))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])


def _with_end(batches):
    yield from batches
    yield None


def _candidates(cells: DataFrame, num, den, first_round) -> DataFrame:
    """Distinct candidate pairs of (cell, sid, n, bits, comp, keys before) rows."""
    ready = cells.repartition("cell").sortWithinPartitions("cell", "n", "sid")
    run = partial(_cells, num=num, den=den, first_round=first_round)
    return ready.mapInArrow(run, "a long, b long").distinct()


@gives_back
def _shingles(batches, k):
    for batch in batches:
        texts = W.text_column(batch, "text")
        for a, b in W.pieces(texts):
            own, h, n = shingle_sets(texts.slice(a, b - a), k)
            first = np.concatenate([[0], np.cumsum(n)])
            size = 64 << np.ceil(np.log2(np.maximum(n, 64) / 64)).astype(np.int64)      # bits: a power of two from n up
            bits, at = _parity_maps(own, h, size)
            yield pa.RecordBatch.from_arrays([_long(_set_ids(first, h)), _long(n), _lists(bits.view(np.int64), at),
                                              _lists(h.view(np.int64), first)], ["sid", "n", "map", "v"])


def _lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(first, pa.int64()), pa.array(values)).cast(pa.list_(pa.int64()))


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that link: first by parity maps as long as the sets (again never above the
    symmetric difference), and what passes, mostly links, by the shingles."""
    def sides(*cols):
        for x in ("a", "b"):
            yield sets.select(F.col("sid").alias(x), *[F.col(c).alias(c + x) for c in cols])

    def folded(x, other):        # the longer map, twice as long, is folded to the shorter
        m = F.size(other)
        return F.when(F.size(x) > m, F.zip_with(F.slice(x, F.lit(1), m), F.slice(x, m + 1, m),
                                                lambda p, q: p.bitwiseXOR(q))).otherwise(x)

    for side in sides("n", "map"):
        pairs = pairs.join(side, side.columns[0])
    apart = F.aggregate(F.zip_with(folded(F.col("mapa"), F.col("mapb")), folded(F.col("mapb"), F.col("mapa")),
                                   lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, x: s + x)
    total = F.col("na") + F.col("nb")
    pairs = pairs.filter(apart <= total - 2 * F.ceil(total * num / (num + den))).select("a", "b")
    for side in sides("v"):
        pairs = pairs.join(side, side.columns[0])
    both = F.size(F.array_intersect("va", "vb"))
    return pairs.filter(both * (num + den) >= num * (F.size("va") + F.size("vb"))).select("a", "b")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of (a, b): node, comp (its smallest node), by alternating large and small stars."""
    edges = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), label)
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
        low = low.select("c", F.least("c", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("c")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .filter("u != v").distinct()
        large = staged(large, label)
        least = large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
        small = (large.join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
                 .filter("u != v").distinct())
        edges = staged(small, label)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == now:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        state = now


def _labels(nodes: DataFrame, comps: DataFrame) -> DataFrame:
    """sid, comp of every node, itself where it has no links."""
    return nodes.join(comps, F.col("sid") == F.col("node"), "left").select("sid", F.coalesce("comp", "sid").alias("comp"))


def _round_one_cells(members: DataFrame) -> DataFrame:
    blocks = F.ceil(F.col("cnt") / CELL)
    own = F.pmod(F.xxhash64("sid"), blocks)
    block = F.explode(F.when((F.col("sid") == F.col("low")) & (blocks > 1), F.sequence(F.lit(0).cast("long"), blocks - 1))
                      .otherwise(F.array(own)))
    return members.withColumn("block", block).select(
        F.xxhash64("key", "block").alias("cell"), "sid", "n", "bits", F.lit(0).cast("long").alias("comp"), *_BEFORE)


def _round_two_cells(members: DataFrame) -> DataFrame:
    """Cells of members with components; of a long list only pairs with a set outside its main component."""
    short = members.filter(F.col("cnt") <= CELL).select(F.xxhash64("key").alias("cell"), "sid", "n", "bits", "comp", *_BEFORE)
    long = members.filter(F.col("cnt") > CELL)
    per = long.groupBy("key", "comp").agg(F.count("*").alias("c"))
    main = per.groupBy(F.col("key").alias("_k")).agg(
        F.max_by("comp", F.struct("c", "comp")).alias("main"), (F.sum("c") - F.max("c")).alias("others"))
    long = long.join(main, F.col("key") == F.col("_k")).filter("others > 0")
    blocks, rows = F.ceil(F.col("cnt") / CELL), F.ceil(F.col("others") / CELL)
    minor = F.col("comp") != F.col("main")
    every = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    one = lambda n, salt: F.array(F.pmod(F.xxhash64("sid", F.lit(salt)), n))
    # a set stands in its block of all rows, and a minor one in its row of all blocks as well
    as_block = long.select("*", F.explode(one(blocks, 1)).alias("x")).select("*", F.explode(every(rows)).alias("y"))
    as_row = long.filter(minor).select("*", F.explode(every(blocks)).alias("x")).select("*", F.explode(one(rows, 2)).alias("y"))
    cells = as_block.unionByName(as_row).select(F.xxhash64("key", "x", "y").alias("cell"), "sid", "n", "bits", "comp", *_BEFORE).distinct()
    return short.unionByName(cells)


def _most_seen(seen: DataFrame) -> pa.Table:
    """Shingles with the highest counts, at most MAX_FREQUENT: all above a count, found from the counts' histogram."""
    seen = staged(seen, "join-seen")
    bins = seen.groupBy(F.least("c", F.lit(100_000)).alias("c")).agg(F.count("*").alias("n")).orderBy(F.col("c").desc()).collect()
    total, least = 0, 1 << 62
    for r in bins:
        total += r.n
        if total > MAX_FREQUENT:
            break
        least = r.c
    return seen.filter(F.col("c") >= least).select("shingle", "c").toArrow()


def linked_sets(documents: DataFrame, k: int, num: int, den: int, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts: row, doc_id, sid, n; labels: sid, comp of sets with a candidate partner)."""
    keyed = documents.select(F.xxhash64(*documents.columns).alias("row"), F.xxhash64(text).alias("text_key"),
                             F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    described = staged(keyed.mapInArrow(partial(_describe, k=k, num=num, den=den), _SETS), "join-sets")
    texts = described.filter("sid is not null")
    often = _most_seen(described.filter("shingle is not null").groupBy("shingle").agg(F.sum("seen").alias("c")))
    frequent = often["shingle"].to_numpy().view(np.uint64)
    order = np.argsort(frequent)
    sizes = {r.n: r["count"] for r in texts.filter(F.col("n").between(1, 2 * LIGHT_MOST)).groupBy("n").count().collect()}
    run = partial(_postings, k=k, num=num, den=den, boundary=choose_boundary(sizes, num, den),
                  frequent=frequent[order], counts=often["c"].to_numpy()[order])
    postings = keyed.select("text").mapInArrow(run, "key long, sid long, n long")
    lists = postings.repartition("key").groupBy("key", "sid", "n").agg(F.lit(1).alias("one"))
    held = staged(lists.drop("one"), "join-postings")
    shared = held.groupBy("key").agg(F.count("*").alias("cnt"), F.min("sid").alias("low")).filter("cnt > 1")
    bits = texts.groupBy(F.col("sid").alias("_sid")).agg(F.first("bits").alias("bits"))
    keys = Window.partitionBy("sid").orderBy("key")     # without a key before, the set's own id, which no other set has
    placed = held.join(shared, "key").select(
        "*", *[F.coalesce(F.lag("key", d).over(keys), "sid").alias(c) for d, c in enumerate(_BEFORE, 1)])
    members = staged(placed.join(bits, F.col("sid") == F.col("_sid")).drop("_sid"), "join-members")

    one = staged(_candidates(_round_one_cells(members), num, den, True), "join-round-one")
    # sets that may link: named in round one, or in a split list, where partners may stand in different cells
    nodes = one.select(F.col("a").alias("sid")).unionByName(one.select(F.col("b").alias("sid"))).unionByName(
        members.filter(F.col("cnt") > CELL).select("sid"))
    nodes = staged(nodes.distinct(), "join-nodes")
    # one text each, read again for its shingles
    of = texts.join(nodes, "sid").groupBy("sid").agg(F.min("text_key").alias("_key")).select("_key")
    sets = staged(keyed.select("text_key", "text").join(of, F.col("text_key") == F.col("_key")).dropDuplicates(["text_key"])
                  .select("text").mapInArrow(partial(_shingles, k=k), "sid long, n long, map array<long>, v array<long>"), "join-shingles")
    links = staged(_verified(one, sets, num, den), "join-links")
    labels = staged(_labels(nodes, components(links)), "join-labels")
    rest = members.join(labels, "sid")
    two = staged(_candidates(_round_two_cells(rest), num, den, False), "join-round-two")
    links = links.unionByName(_verified(two, sets, num, den)).distinct()
    return texts.select("row", "doc_id", "sid", "n"), staged(_labels(nodes, components(links)), "join-components")


def jaccard_components(documents: DataFrame, k: int = 5, num: int = 4, den: int = 5, text: str = "text") -> DataFrame:
    """Per document: row (hash of its columns), doc_id, n_shingles, component_id (smallest doc_id reachable)."""
    texts, labels = linked_sets(documents, k, num, den, text)
    texts = texts.join(labels.withColumnRenamed("sid", "_s"), F.col("sid") == F.col("_s"), "left").withColumn(
        "comp", F.coalesce("comp", "sid"))
    least = texts.filter("n > 0").groupBy(F.col("comp").alias("_c")).agg(F.min("doc_id").alias("least"))
    joined = texts.filter("n > 0").join(least, F.col("comp") == F.col("_c")).select(
        "row", "doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"), "comp")
    return joined.unionByName(texts.filter("n = 0").select(
        "row", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("comp")))


def keep_one_per_component(documents: DataFrame, k: int = 5, num: int = 4, den: int = 5, text: str = "text") -> DataFrame:
    """``documents`` without near copies: of each component one row with the smallest doc_id; texts without words all stay."""
    found = jaccard_components(documents, k, num, den, text).filter("n_shingles > 0")
    winner = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row").alias("w"))
    rows = found.groupBy("comp").agg(winner.alias("w")).select(F.col("w.row").alias("_row"))
    cols = documents.columns
    keyed = documents.withColumn("_of", F.xxhash64(*cols))
    wordless = ~F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = keyed.join(rows, F.col("_of") == F.col("_row")).dropDuplicates(["_of"])
    return kept.select(*cols).unionByName(documents.filter(wordless))


def op1_jaccard_join(spark, sf_dir) -> DataFrame:
    """Three-word shingles, similarity 0.9: set size and component of every document."""
    from quarry.llm.io import read

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_components(docs, 3, 90, 100).select("doc_id", "n_shingles", "component_id")
