"""MaxScore: the split by the threshold, thresholds carried between shards, repeated rows and ids."""

import collections

import numpy as np
import pytest

from quarry.llm import maxscore


def _brute(terms, ids, query, own, k):
    s = query @ terms
    return [(int(i), int(s[i])) for i in np.lexsort((ids, -s)) if ids[i] != own][:k]


@pytest.mark.parametrize("kind", [np.int64, np.float64])
def test_shard_equals_brute_force_and_reads_less(kind):
    rng = np.random.default_rng(3)
    terms = np.floor(rng.normal(size=(24, 9000)) * 256 / np.arange(1, 25)[:, None]).astype(kind)
    terms[:, 4000:4600] = terms[:, :1]                                   # ties
    ids = rng.permutation(9000)
    shard = maxscore.Shard(terms, ids)
    for q in range(0, 9000, 300):
        query, own = terms[:, q], int(ids[q])
        want = _brute(terms, ids, query, own, 5)
        rows, scores, alone = shard.top_k(query, own, 5)
        assert list(zip(rows.tolist(), scores.astype(int).tolist())) == want
        rows, scores, carried = shard.top_k(query, own, 5, theta=want[-1][1])
        assert list(zip(rows.tolist(), scores.astype(int).tolist())) == want
        assert carried <= alone < terms.size                              # a higher threshold: fewer essential terms
        assert len(shard.top_k(query, own, 5, theta=want[0][1] + 1)[0]) == 0


def test_repeated_rows_and_ids(spark):
    rows = [(50, [3, 1]), (50, [3, 1]), (50, [-2, 4]), (7, [5, 5]), (7, [5, 5]), (7, [5, 5]), (8, [1]), (None, [5, 5]), (9, [])]
    v = spark.createDataFrame(rows, "id long, v array<long>")
    got = collections.Counter(map(tuple, maxscore.top_k(v, v.filter("id % 50 = 0"), 4, shard=2, block=1, first=2).collect()))
    want = collections.Counter()
    for query in ([3, 1], [-2, 4]):                                       # the repeated query is one
        score = [(sum(a * b for a, b in zip(query, x)), i) for i, x in rows if i != 50]
        score.sort(key=lambda r: (-r[0], r[1] is None, r[1]))
        want.update((50, rank, i, s) for rank, (s, i) in enumerate(score[:4], 1))
    assert got == want
