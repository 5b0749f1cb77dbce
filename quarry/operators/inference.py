"""Pluggable model stages (U1 embed, U4 complete).

The engine makes no network calls.  Callers pass their own functions, which
are called once per Arrow batch on the one text column they need, or
``PerTask(make)``: ``make()`` runs once in every task and returns the function,
so a client or a model is set up once and serves all of the task's batches.
Any exception fails the task (and, after Spark's retries, the job), which is
the reference's "any failure fails the request" rule.

Without a caller function ``embed`` uses a lexical hashing embedder (token ->
md5 bucket -> counts -> L2 norm).  It is a deterministic stand-in for tests
and benchmarks, not a semantic model.  Tokens and buckets are built-in
expressions (DuckDB can reproduce them); the counting is a vectorised
Arrow-batched helper.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import patterns as P

DEFAULT_DIM = 64

EmbedFn = Callable[[list[str]], Sequence[Sequence[float]]]
CompleteFn = Callable[[list[str], dict], Sequence[str]]


@dataclass(frozen=True)
class PerTask:
    """``make()`` is called once per task and returns the embed or complete function for its batches."""

    make: Callable[[], Callable]


def token_buckets(text: Column, dim: int = DEFAULT_DIM) -> Column:
    """Bucket of every lower-cased word token: first 32 bits of md5, mod dim."""
    toks = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(P.P_EMBED_TOKEN), 0)
    return F.transform(toks, lambda t: F.pmod(
        F.conv(F.substr(F.md5(t), F.lit(1), F.lit(8)), 16, 10).cast("long"), F.lit(dim)))


def _densify(dim: int):
    """Arrow-batched helper: bucket lists -> unit-length count vectors."""
    def densify(buckets: pa.Array) -> pa.Array:
        n = pc.fill_null(pc.list_value_length(buckets), 0).to_numpy(zero_copy_only=False)
        place = np.repeat(np.arange(len(n)) * dim, n) + buckets.flatten().to_numpy(zero_copy_only=False)
        counts = np.bincount(place, minlength=len(n) * dim).reshape(len(n), dim).astype(np.float64)
        norm = np.sqrt((counts ** 2).sum(1, keepdims=True))
        unit = (counts / np.where(norm > 0, norm, 1)).astype(np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * dim), pa.array(unit.ravel()))

    densify.__annotations__ = {"buckets": pa.Array, "return": pa.Array}
    return F.arrow_udf(densify, T.ArrayType(T.FloatType()))


def hashing_embedding(text: Column, dim: int = DEFAULT_DIM) -> Column:
    """Unit-length bag-of-buckets vector (zero vector for a text without tokens).

    Tokens and md5 buckets are computed in the JVM (one pass); only the
    counting of the small bucket array runs in the Arrow-batched helper.
    """
    return _densify(dim)(token_buckets(text, dim))


def embed(df: DataFrame, text_col: str, embed_fn: EmbedFn | PerTask | None = None,
          dim: int = DEFAULT_DIM, out_col: str = "embedding") -> DataFrame:
    """Add ``out_col ARRAY<FLOAT>``, one vector per row, in row order.

    Only ``text_col`` travels to Python; the other columns wait in the JVM.
    """
    if embed_fn is None:
        return df.withColumn(out_col, hashing_embedding(F.col(text_col), dim))

    def vectors(texts: list[str], fn: EmbedFn) -> pa.Array:
        found = [np.asarray(v, np.float32) for v in fn(texts)]
        if len(found) != len(texts):
            raise RuntimeError(f"embed_fn returned {len(found)} vectors for {len(texts)} texts")
        return pa.array(found, pa.list_(pa.float32()))

    return df.withColumn(out_col, _model_column(embed_fn, vectors, T.ArrayType(T.FloatType()))(text_col))


def complete(df: DataFrame, prompt_col: str, complete_fn: CompleteFn | PerTask, temperature: float,
             max_tokens: int = 2048, system: str = P.SYSTEM_MESSAGE,
             out_col: str = "response") -> DataFrame:
    """U4: add ``out_col`` with the model's answer to each prompt.

    ``complete_fn(prompts, params)`` receives the Arrow batch's prompts and
    ``{"temperature", "max_tokens", "system"}``; it returns one string each.
    Responses are stripped like the reference's clients do.
    """
    if complete_fn is None:
        raise ValueError("complete_fn is required: the engine bundles no model client")
    params = {"temperature": temperature, "max_tokens": max_tokens, "system": system}

    def answers(prompts: list[str], fn: CompleteFn) -> pa.Array:
        found = list(fn(prompts, dict(params)))
        if len(found) != len(prompts):
            raise RuntimeError(f"complete_fn returned {len(found)} answers for {len(prompts)} prompts")
        return pa.array(["" if o is None else str(o).strip() for o in found], pa.string())

    return df.withColumn(out_col, _model_column(complete_fn, answers, T.StringType())(prompt_col))


def _model_column(fn, call, kind: T.DataType):
    """An expression over one text column: ``call(texts, function)`` for every Arrow batch, null texts as empty.

    It counts as non-deterministic, so the optimiser neither repeats a model
    call nor moves a filter below it.
    """
    make = fn.make if isinstance(fn, PerTask) else lambda: fn

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        started = make()
        for texts in batches:
            yield call(pc.fill_null(texts.cast(pa.string()), "").to_pylist(), started)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind).asNondeterministic()


def echo_completion(prompts: list[str], params: dict) -> list[str]:
    """A deterministic stand-in model for tests and checks: answers every
    prompt with the prompt itself (whose template already has a fenced block
    and an ``## Explanation`` section).  Not a model; never a default."""
    return list(prompts)
