"""Vector codes: product quantisation in exact integers, with norm-of-sum bounds.

Vectors are cut into equal parts, each part position has a codebook, and rounds
of assigning parts to their nearest entry and moving entries to the floored mean
of their parts refine the codebooks.  Rows live in a table that each round
writes anew: vector, code and bounds of every part.

Bounds.  A part keeps an upper bound of the distance to its entry and a lower
bound of the distance to every other entry, each with the round it was measured
in (its stamp), and the driver keeps the codebooks of all rounds (entries x
dimension x rounds integers, whatever the table's size).  An entry that moved
since that round is farther or nearer by no more than the length of its *net*
displacement, the norm of the sum of its moves, taken from the history; that is
never above the sum of the moves' norms that an accumulated drift would charge.
If the upper bound stays below the lower one, the part keeps its entry unseen.
Otherwise its own entry is measured first, and only if that does not settle it
are all entries measured again, in integers, ties to the lower index.  Bounds
are rounded outwards, and an equal pair is always measured, so results are those
of measuring everything.

Sums move with the parts: a task adds what joined an entry and subtracts what
left it, and writes one row of such differences next to its vectors, so one pass
serves both.  Only these sums (entries x dimension numbers) reach the driver.

Defined cases: rows whose vector is null or holds null or non-finite components
are dropped, and so are vectors of another length than the first kept one's (by
vec_id; lengths that the parts do not divide do not count).  Among rows of one
vec_id the smallest vector is a codebook's start; a null vec_id starts none but
is coded.  With fewer kept vec_ids than entries the codebooks are shorter.
Repeated rows are coded alike and count each.  An empty table, or one without a
vec_id among its kept rows, gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.io import read, release, staged

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: per part: entry, round of the upper and of the lower bound, the bounds
_STATE = np.dtype([("code", "u1"), ("upper_at", "u1"), ("lower_at", "u1"), ("upper", "<f4"), ("lower", "<f4")])
_ROWS = "vec_id long, label {label}, v binary, state binary, sums binary, error long"


def _flat(column: pa.Array, dtype) -> np.ndarray:
    """The values of a binary column, one after the other."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def _binary(values: np.ndarray) -> pa.Array:
    """One binary value per row of a two-dimensional array."""
    return pa.array([r.tobytes() for r in values], pa.binary())


def _integers(batches, scale):
    """Vectors as 32-bit integers floor(scale * x)."""
    for batch in batches:
        column = batch.column(2)
        x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        v = np.floor(scale * x)
        if len(v) and np.abs(v).max() >= 1 << 30:
            raise ValueError("vector components must stay below 2**30 / scale")
        v = v.astype("<i4").reshape(len(column), -1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _binary(v)], ["vec_id", "label", "v"])


class Books:
    """Codebooks of all rounds so far: (rounds, parts, entries, width)."""

    def __init__(self, history: np.ndarray):
        self.now = history[-1]
        self.round = len(history) - 1
        self.net = np.sqrt(((history[-1][None] - history) ** 2).sum(-1).astype(np.float64))     # (round, part, entry)
        rounds, parts, entries = self.net.shape
        self.net_of_others = np.zeros_like(self.net)
        if entries > 1:
            top = np.sort(self.net, axis=-1)
            largest = self.net == top[..., -1:]
            single = largest & (largest.sum(-1, keepdims=True) == 1)
            self.net_of_others = np.where(single, top[..., -2:-1], top[..., -1:])

    def distances(self, part: int, v: np.ndarray) -> np.ndarray:
        """Exact squared distances (rows, entries)."""
        e = self.now[part]
        return (v ** 2).sum(1)[:, None] - 2 * (v @ e.T) + (e ** 2).sum(1)[None]

    def own(self, part: int, v: np.ndarray, code: np.ndarray) -> np.ndarray:
        return ((v - self.now[part][code]) ** 2).sum(1)


def _above(squared):
    """A float not below the root."""
    return np.nextafter(np.sqrt(squared.astype(np.float64)).astype(np.float32), np.float32(np.inf))


def _below(squared):
    return np.nextafter(np.sqrt(squared.astype(np.float64)).astype(np.float32), np.float32(-np.inf))


def assign(books: Books, v: np.ndarray, state: np.ndarray | None) -> tuple[np.ndarray, int]:
    """New state of (rows, parts, width) vectors, and how many parts were measured against all entries."""
    n, parts, _ = v.shape
    new = np.zeros((n, parts), _STATE) if state is None else state.copy()
    now, scans = books.round, 0
    for p in range(parts):
        s, part = new[:, p], v[:, p]
        todo = np.arange(n)
        if state is not None:
            upper = s["upper"].astype(np.float64) + books.net[s["upper_at"], p, s["code"]]
            lower = s["lower"].astype(np.float64) - books.net_of_others[s["lower_at"], p, s["code"]]
            slack = 1e-6 * (1 + lower)                       # above the rounding of these sums
            todo = np.flatnonzero(~(upper + slack < lower))
            own = _above(books.own(p, part[todo], s["code"][todo]))
            s["upper"][todo], s["upper_at"][todo] = own, now
            todo = todo[~(own.astype(np.float64) + slack[todo] < lower[todo])]
        scans += len(todo)
        if len(todo):
            d = books.distances(p, part[todo])
            code = d.argmin(1)
            rows = np.arange(len(todo))
            least = d[rows, code]
            d[rows, code] = np.iinfo(np.int64).max
            s["code"][todo], s["upper"][todo], s["lower"][todo] = code, _above(least), _below(d.min(1))
            s["upper_at"][todo] = s["lower_at"][todo] = now
    return new, scans


def _round(batches, history, last):
    """Rows with their new state, and after them one row of what joined and left the entries;
    ``last`` writes errors instead."""
    books = Books(history)
    parts, entries, width = books.now.shape
    joined = np.zeros((parts, entries, width + 1), np.int64)          # a component more counts the parts
    batch = None
    for batch in batches:
        column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        if not len(batch):
            continue
        v = _flat(column["v"], "<i4").astype(np.int64).reshape(len(batch), parts, width)
        old = _flat(column["state"], _STATE).reshape(len(batch), parts) if not column["state"].null_count else None
        new, _ = assign(books, v, old)
        error = None
        if last:
            error = sum(books.own(p, v[:, p], new["code"][:, p]) for p in range(parts))
        else:
            one = np.concatenate([v, np.ones((len(v), parts, 1), np.int64)], axis=2)
            for p in range(parts):
                moved = slice(None) if old is None else np.flatnonzero(old["code"][:, p] != new["code"][:, p])
                np.add.at(joined[p], new["code"][moved, p], one[moved, p])
                if old is not None:
                    np.subtract.at(joined[p], old["code"][moved, p], one[moved, p])
        yield _out(batch, column["vec_id"], column["label"], pa.nulls(len(batch), pa.binary()) if last else column["v"],
                   _binary(new["code"] if last else new), None, error)
    if batch is not None and not last:
        yield _out(batch, None, None, None, None, joined, None)


def _out(batch, vec_id, label, v, state, sums, error):
    n = 1 if vec_id is None else len(vec_id)
    blank = lambda x, kind: pa.nulls(n, kind) if x is None else x
    return pa.RecordBatch.from_arrays([
        blank(vec_id, pa.int64()), blank(label, batch.schema.field("label").type), blank(v, pa.binary()), blank(state, pa.binary()),
        pa.nulls(n, pa.binary()) if sums is None else pa.array([sums.astype("<i8").tobytes()], pa.binary()),
        pa.nulls(n, pa.int64()) if error is None else pa.array(error, pa.int64())], ["vec_id", "label", "v", "state", "sums", "error"])


def _added(batches):
    """(place, x): the tasks' differences, summed within this task."""
    total = None
    for batch in batches:
        for row in batch.column(0).to_pylist():
            x = np.frombuffer(row, "<i8")
            total = x.copy() if total is None else total + x
    if total is not None:
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["place", "x"])


def _differences(rows: DataFrame, shape) -> np.ndarray:
    found = rows.filter("sums is not null").select("sums").mapInArrow(_added, "place long, x long") \
        .groupBy("place").agg(F.sum("x").alias("x")).collect()             # parts x entries x (width + 1) numbers
    out = np.zeros(shape, np.int64)
    for r in found:
        out.flat[r.place] = r.x
    return out


def _kept(vectors: DataFrame, id_col: str, vector: str, label: str, parts: int) -> DataFrame:
    """vec_id, label, vector of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    finite = ~F.exists("vector", lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    return rows.filter(F.col("vector").isNotNull() & finite & (F.size("vector") > 0) & (F.size("vector") % parts == 0))


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
          id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame | None, np.ndarray | None]:
    """(rows: vec_id, label, code as one byte a part, squared error; codebooks: (parts, entries, width)),
    or (None, None) if no row can start a codebook.  At most 256 entries and 255 rounds."""
    kept = _kept(vectors, id_col, vector, label, parts)
    first = kept.filter("vec_id is not null").select("vec_id", F.size("vector").alias("n")).orderBy("vec_id", "n").limit(1).collect()
    if not first:
        return None, None
    width = first[0].n // parts
    kept = kept.filter(F.size("vector") == first[0].n)
    ids = [r.vec_id for r in kept.filter("vec_id is not null").select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
    kind = kept.schema["label"].dataType.simpleString()
    rows = staged(kept.mapInArrow(partial(_integers, scale=scale), f"vec_id long, label {kind}, v binary"), "codes-vectors")
    start = kept.filter(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("vector").alias("vector")).collect()
    starts = {r.vec_id: np.floor(scale * np.array(r.vector, np.float64)).astype(np.int64).reshape(parts, width) for r in start}
    history = np.stack([starts[i] for i in sorted(starts)], axis=1)[None]
    total = np.zeros((*history.shape[1:3], width + 1), np.int64)
    rows = rows.withColumn("state", F.lit(None).cast("binary"))
    schema = _ROWS.format(label=kind)
    for _ in range(rounds):
        after = staged(rows.select("vec_id", "label", "v", "state").mapInArrow(partial(_round, history=history, last=False), schema),
                       "codes-round")
        release(rows)
        total += _differences(after, total.shape)
        sums, n = total[..., :-1], total[..., -1:]
        history = np.concatenate([history, np.where(n > 0, sums // np.maximum(n, 1), history[-1])[None]])
        rows = after.filter("sums is null")
    done = staged(rows.select("vec_id", "label", "v", "state").mapInArrow(partial(_round, history=history, last=True), schema),
                  "codes")
    release(rows)
    return done.select("vec_id", "label", F.col("state").alias("code"), "error"), history[-1]


def op11_vector_codes(spark, sf_dir) -> DataFrame:
    """Codes, errors and codebook digest of all embeddings: 8 parts, 16 entries, 6 rounds, components times 4096."""
    rows, books = train(read(spark, sf_dir, "embeddings"))
    if rows is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    of_label = rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return rows.join(of_label, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
