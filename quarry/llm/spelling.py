"""Spelling variants: words that differ by one inserted, deleted or replaced letter, grouped under the commoner form.

Words come from whole texts (maximal runs of Latin letters, A-Z lower-cased) and
are counted in the tasks before any shuffle.  Near words are found in a
frequency-vector trie: letters fall into ``GROUPS`` groups, a word is the vector
of its letter counts by group, and level g of the trie branches on the count of
group g.  One edit changes the vector by at most a surplus of one in one group
and a deficit of one in one group, so a depth-first search that may spend each
once meets the leaves of all near words; the words of those leaves are verified
letter by letter.

The trie is spread over tasks by its upper levels: a block is the subtree under
a prefix of counts, cut at the first depth at which no subtree holds more than
``BLOCK`` words (or at the leaves; a leaf with more is cut into chunks that are
all searched).  Words travel to the blocks that their budget reaches, and each
block returns one row per searching word (number of near words, the best of
them), never pairs.  Groups are dealt out by the letters' counts, so that the
first levels split best; that only changes speed.

Roots follow forms by pointer doubling: a form has at least ``RATIO`` times the
word's count, so chains are short and never meet themselves.

Defined cases: null and empty texts have no words; a null doc_id is written as
an empty string in the noise rule of ``op12``; repeated rows count again; of near words with equal
counts the first in code-point order is the form; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import words as W
from quarry.llm.io import read, staged

GROUPS, BLOCK, RATIO, HELD, FRONTIER = 12, 4096, 5, 200_000, 1 << 17
#: a-z and U+00C0..U+00FF in UTF-8 after lower-casing A-Z; the lead byte 0xC3 never stands inside another character
_LETTER = rb"(?:[a-z]|\xc3[\x80-\xbf])"


# ------------------------------------------------------------- counting
def _texts(batch):
    """(doc_id as text, lower-cased UTF-8 bytes) of the rows that have a text."""
    texts = W.text_column(batch, "text").cast(pa.large_binary())
    for i, t in zip(W.text_column(batch, "doc_id"), texts):
        if t.is_valid:
            yield b"" if not i.is_valid else str(i.as_py()).encode(), t.as_py().lower()


def _count(batches, least, noise):
    """(word, n) of a task's texts; words of ``least`` letters or more, given back whenever ``HELD`` are held.

    ``noise``: a run whose crc32 of ``<doc_id>:<run>`` that number divides loses one letter (0: none does)."""
    run = re.compile(_LETTER + b"{%d,}" % least)
    held: Counter = Counter()
    for batch in batches:
        for doc, text in _texts(batch):
            seed = zlib.crc32(doc + b":")
            found = Counter(m.group() for m in run.finditer(text)) if len(text) > 1 << 22 else Counter(run.findall(text))
            for w, n in found.items():
                h = zlib.crc32(w, seed)
                if noise and h % noise == 0:
                    s = w.decode()
                    at = h % len(s)
                    if len(s) > least:
                        held[(s[:at] + s[at + 1:]).encode()] += n
                else:
                    held[w] += n
            if len(held) > HELD:
                yield _counted(held)
    if held:
        yield _counted(held)


def _counted(held: Counter) -> pa.RecordBatch:
    out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())],
                                     ["word", "n"])
    held.clear()
    return out


def count_words(docs: DataFrame, least_letters: int = 6, least_n: int = 5, noise: int = 0) -> DataFrame:
    """word, n of the words with enough letters and occurrences over all texts (columns doc_id and text)."""
    parts = docs.select("doc_id", "text").mapInArrow(partial(_count, least=least_letters, noise=noise), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n)


# ------------------------------------------------------------- vectors
class Letters:
    """Words as Latin-1 bytes: one byte a letter."""

    def __init__(self, words: list[str]):
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.data = np.frombuffer("".join(words).encode("latin-1"), np.uint8)

    def vectors(self, group_of: np.ndarray) -> np.ndarray:
        """(words, groups): letters of each group, 255 at most (longer runs share the last branch and are verified)."""
        owner = np.repeat(np.arange(len(self.size)), self.size)
        groups = int(group_of.max()) + 1
        v = np.bincount(owner * groups + group_of[self.data], minlength=len(self.size) * groups)
        return np.minimum(v.reshape(len(self.size), groups), 255)


def letter_groups(vocabulary: DataFrame, groups: int) -> np.ndarray:
    """Group of each letter (by Latin-1 code): letters by falling count over the vocabulary, dealt out to and fro."""
    letters = vocabulary.select(F.explode(F.split("word", "")).alias("c")).filter("c != ''")
    seen = letters.groupBy(F.ascii("c").alias("code")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "code").collect()
    out = np.zeros(256, np.int64)
    for rank, r in enumerate(seen):                      # at most 90 letters
        turn, place = divmod(rank, groups)
        out[r.code] = place if turn % 2 == 0 else groups - 1 - place
    return out


def _prefixes(batches, group_of):
    """word, n and the vector as bytes, one byte a level (255 for more)."""
    for batch in batches:
        words = W.text_column(batch, "word").to_pylist()
        v = Letters(words).vectors(group_of).astype(np.uint8)
        vec = pa.array([x.tobytes() for x in v], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), vec], ["word", "n", "vec"])


def _reach(prefix: bytes) -> set[bytes]:
    """Prefixes that a surplus of one and a deficit of one lead to, the prefix itself included."""
    def moved(p, step):
        for g, c in enumerate(p):
            if 0 <= c + step <= 255:
                yield p[:g] + bytes([c + step]) + p[g + 1:]
    more = set(moved(prefix, 1))
    return {prefix} | more | set(moved(prefix, -1)) | {q for p in more for q in moved(p, -1)}


def _visits(batches, depth):
    """A row for each prefix that a word must search."""
    known: dict[bytes, list[bytes]] = {}
    for batch in batches:
        prefixes = [v[:depth] for v in W.text_column(batch, "vec").to_pylist()]
        at, keys = [], []
        for i, p in enumerate(prefixes):
            reach = known.get(p)
            if reach is None:
                if len(known) > 10_000:
                    known.clear()
                reach = known[p] = sorted(_reach(p))
            at += [i] * len(reach)
            keys += reach
            if len(at) > 1 << 16:
                yield _visit(batch, at, keys)
                at, keys = [], []
        if at:
            yield _visit(batch, at, keys)


def _visit(batch, at, keys):
    rows = pa.array(at, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), W.text_column(batch, "word").take(rows),
                                       W.text_column(batch, "vec").take(rows)], ["prefix", "word", "vec"])


# ------------------------------------------------------------- the trie
class Trie:
    """Levels of a frequency-vector trie over the rows of a sorted matrix.

    ``keys[g]`` lists the nodes of level g + 1 as (parent node, count) codes in
    order, ``span`` the rows of each leaf."""

    def __init__(self, vectors: np.ndarray):
        self.order = np.lexsort(vectors.T[::-1])
        v = vectors[self.order]
        node = np.zeros(len(v), np.int64)
        self.keys = []
        for g in range(v.shape[1]):
            code = node * 256 + v[:, g]
            new = np.concatenate([[True], code[1:] != code[:-1]])
            self.keys.append(code[new])
            node = np.cumsum(new) - 1
        self.span = np.searchsorted(node, np.arange(len(self.keys[-1]) + 1))

    def near_leaves(self, vectors: np.ndarray):
        """(word, leaf) of every leaf that a surplus and a deficit of one reach, in bounded runs, depth first."""
        all_words = np.arange(len(vectors))
        zero = np.zeros(len(vectors), np.int64)
        stack = [(0, all_words[a:a + FRONTIER], zero[a:a + FRONTIER], zero[a:a + FRONTIER])
                 for a in range(0, len(vectors), FRONTIER)]
        while stack:
            g, word, node, spent = stack.pop()               # spent: 1 the surplus, 2 the deficit
            if g == len(self.keys):
                yield word, node
                continue
            found = []
            for step, cost in ((0, 0), (1, 1), (-1, 2)):
                may = (spent & cost) == 0
                count = vectors[word[may], g] + step         # above 255 is no branch: step 0 stands for it
                code = node[may] * 256 + count
                at = np.minimum(np.searchsorted(self.keys[g], code), len(self.keys[g]) - 1)
                hit = (self.keys[g][at] == code) & (count >= 0) & (count <= 255)
                found.append((word[may][hit], at[hit], spent[may][hit] | cost))
            word, node, spent = (np.concatenate(x) for x in zip(*found))
            stack += [(g + 1, word[a:a + FRONTIER], node[a:a + FRONTIER], spent[a:a + FRONTIER])
                      for a in range(0, len(word), FRONTIER)]


def one_apart(a: Letters, i: np.ndarray, b: Letters, j: np.ndarray) -> np.ndarray:
    """Whether words i of a and j of b differ by exactly one inserted, deleted or replaced letter."""
    out = np.zeros(len(i), bool)
    gap = a.size[i] - b.size[j]
    for x, xi, y, yj, rows in ((a, i, b, j, gap == 0), (a, i, b, j, gap == -1), (b, j, a, i, gap == 1)):
        rows = np.flatnonzero(rows)
        shift = int(gap[rows[0]] != 0) if len(rows) else 0
        upto = np.cumsum(x.size[xi[rows]])
        at = 0
        while at < len(rows):                                  # about a million letters at a time
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + (1 << 20), "right")))
            part = rows[at:end]
            size = x.size[xi[part]]
            first = np.concatenate([[0], np.cumsum(size)])
            place = np.arange(first[-1]) - np.repeat(first[:-1], size)
            left = x.data[np.repeat(x.first[xi[part]], size) + place]
            start = np.repeat(y.first[yj[part]], size) + place
            differ = left != y.data[start]
            if not shift:
                out[part] = np.add.reduceat(differ, first[:-1]) == 1
            else:                                              # equal up to some place, and shifted by one from it on
                shifted = left != y.data[start + 1]
                head = np.minimum.reduceat(np.where(differ, place, np.repeat(size, size)), first[:-1])
                tail = np.maximum.reduceat(np.where(shifted, place + 1, 0), first[:-1])
                out[part] = tail <= head
            at = end
    return out


def _search(key, block: pa.Table, asking: pa.Table) -> pa.Table:
    """Of the words asking: near words in this block, their number and the best of them."""
    schema = pa.schema([("word", pa.string()), ("near", pa.int64()), ("form", pa.string()), ("form_n", pa.int64())])
    if not len(block) or not len(asking):
        return schema.empty_table()
    words, n = block["word"].to_pylist(), block["n"].to_numpy()
    mine, asked = Letters(words), asking["word"].to_pylist()
    others = Letters(asked)
    read_vec = lambda t: np.frombuffer(b"".join(t["vec"].to_pylist()), np.uint8).reshape(len(t), -1).astype(np.int64)
    trie, vectors = Trie(read_vec(block)), read_vec(asking)
    by_rank = np.empty(len(words), np.int64)                  # 0: largest n, first in code-point order
    by_rank[sorted(range(len(words)), key=lambda r: (-n[r], words[r]))] = np.arange(len(words))
    near = np.zeros(len(asked), np.int64)
    best = np.full(len(asked), len(words), np.int64)
    for word, leaf in trie.near_leaves(vectors):
        size = np.diff(trie.span)[leaf]
        upto = np.cumsum(size)
        at = 0
        while at < len(word):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + FRONTIER, "right")))
            s = size[at:end]
            i = np.repeat(word[at:end], s)
            first = np.cumsum(s) - s
            j = trie.order[np.repeat(trie.span[leaf[at:end]], s) + np.arange(len(i)) - np.repeat(first, s)]
            ok = one_apart(others, i, mine, j)
            np.add.at(near, i[ok], 1)
            np.minimum.at(best, i[ok], by_rank[j[ok]])
            at = end
    found = np.flatnonzero(near)
    of_rank = np.argsort(by_rank)
    return pa.table([pa.array([asked[x] for x in found], pa.string()), pa.array(near[found]),
                     pa.array([words[of_rank[best[x]]] for x in found], pa.string()),
                     pa.array(n[of_rank[best[found]]].astype(np.int64) if len(found) else near[:0])], schema=schema)


def _depth(vectors: DataFrame, groups: int, block: int) -> int:
    """The first depth at which no subtree holds more than ``block`` words, the leaves' at most."""
    depths = F.explode(F.sequence(F.lit(1), F.lit(groups))).alias("d")
    per = vectors.groupBy("vec").agg(F.count("*").alias("c")).select("vec", "c", depths)
    per = per.groupBy("d", F.expr("substring(vec, 1, d)").alias("prefix")).agg(F.sum("c").alias("c"))
    most = {r.d: r.m for r in per.groupBy("d").agg(F.max("c").alias("m")).collect()}
    return next((d for d in sorted(most) if most[d] <= block), groups)


def near_words(vocabulary: DataFrame, groups: int = GROUPS, block: int = BLOCK) -> DataFrame:
    """word, n, n_near, and the near word of largest n (best, best_n; null without any) of every word of (word, n)."""
    vocabulary = staged(vocabulary, "spelling-words")
    group_of = letter_groups(vocabulary, groups)
    vectors = staged(vocabulary.mapInArrow(partial(_prefixes, group_of=group_of), "word string, n long, vec binary"),
                     "spelling-vectors")
    depth = _depth(vectors, int(group_of.max()) + 1, block)
    prefix = F.expr(f"substring(vec, 1, {depth})").alias("prefix")
    subtrees = vectors.groupBy(prefix).agg(F.ceil(F.count("*") / block).cast("int").alias("chunks"))
    held = vectors.select(prefix, "word", "n", "vec").join(subtrees, "prefix") \
        .select("prefix", F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int").alias("chunk"), "word", "n", "vec")
    visits = vectors.select("word", "vec").mapInArrow(partial(_visits, depth=depth), "prefix binary, word string, vec binary")
    visits = visits.join(subtrees.select(F.col("prefix").alias("under"), F.col("chunks").alias("of")), F.col("prefix") == F.col("under")) \
        .select("under", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("part"), "word", "vec")
    found = held.groupBy("prefix", "chunk").cogroup(visits.groupBy("under", "part")).applyInArrow(
        _search, "word string, near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("minus"), F.col("form"))).alias("best")
    found = found.groupBy("word").agg(F.sum("near").alias("near"), best)
    return vocabulary.join(found, "word", "left").select(
        "word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"),
        F.col("best.form").alias("best"), (-F.col("best.minus")).alias("best_n"))


def variant_groups(vocabulary: DataFrame, ratio: int = RATIO, groups: int = GROUPS, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of a vocabulary (word, n)."""
    is_form = F.col("best_n") >= ratio * F.col("n")
    found = staged(near_words(vocabulary, groups, block).select(
        "word", F.when(is_form, F.col("best")).alias("form"), "n", "n_near", F.when(is_form, F.col("best_n")).alias("form_n")),
        "spelling-forms")
    steps = found.filter("form is not null").select("word", F.col("form").alias("to"))
    while True:                                               # each round doubles the steps taken
        further = steps.select(F.col("word").alias("to"), F.col("to").alias("next"))
        joined = steps.join(further, "to", "left")
        steps = staged(joined.select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")),
                       "spelling-roots")
        if not steps.filter("moved").take(1):
            break
        steps = steps.select("word", "to")
    return found.join(steps.select("word", F.col("to").alias("root")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir) -> DataFrame:
    """Spelling variants of the words of all documents (6 letters and 5 occurrences or more), with the contract's noise."""
    docs = read(spark, sf_dir, "documents")
    return variant_groups(count_words(docs, 6, 5, 199))
