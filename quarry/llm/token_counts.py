"""Token counts through a digest cache.

A text's count is kept under two digests: of its normalised content (SHA-256
of the UTF-8 bytes) and of the tokenizer's version (its file, library, library
version and settings).  Documents are joined to the stored counts on both;
only distinct contents without a stored count are encoded, and their counts are
appended to the cache.  A second run over the same texts encodes nothing; a
changed tokenizer file or library has another digest, so old counts are never
taken for new ones.

Plan: one narrow pass writes the digests (no text), the misses are one row per
content (combined map-side, so a text that a third of the documents share is one
row) and a semi-join on a row hash picks one document of each to be encoded.
Few misses are broadcast by Spark's own size check and the texts stay where they
are; many are shuffled once, by row and not by content, so copies never meet in
one task.  The result joins digests with counts; no text takes part.

Inside a task a byte-level tokenizer's text is cut before every single space
that a visible character follows: no token crosses such a place, so the counts
of the pieces add up to the library's count of the whole text, each distinct
piece is encoded once, and a very long text needs no memory of its length times
the library's offsets.  Other tokenizers encode whole texts.

Defined cases: a null text is empty and has 0 tokens; equal texts and repeated
rows get equal counts, one row each; an empty table gives no rows; columns of
the documents that are called like a result (``n_bytes``, ``n_tokens``) give way
to it; a null doc_id takes part.  Contents are told apart by SHA-256.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from quarry.llm import words as W
from quarry.llm.io import read, staged
from quarry.session import ensure_checkpoint_dir

PIECES, PIECE_CHARS = 500_000, 64      # pieces remembered by a task, and the longest of them
_CACHE = "digest binary, n_bytes long, n_tokens long, tokenizer string"


# ------------------------------------------------------------- tokenizers
@lru_cache(maxsize=4)
def tokenizer_digest(path: str) -> str:
    """Digest of a tokenizer's version: file content, library, its version and the settings used here."""
    with open(path, "rb") as f:
        h = hashlib.sha256(f.read())
    if path.endswith(".json"):
        import tokenizers as library
    else:
        import sentencepiece as library
    h.update(f"\n{library.__name__} {library.__version__} no added tokens, no truncation, no padding".encode())
    return h.hexdigest()


class _Json:
    """A ``tokenizers`` file; counts of many texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def __call__(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def cut(self):
        """Pattern that cuts a text where no token can cross, or None: before a single space, if what
        follows is visible and begins no added token (byte-level pieces, text not normalised)."""
        import json

        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        plain = not spec.get("normalizer") and not spec.get("post_processor") and pre.get("type") == "ByteLevel" \
            and pre.get("use_regex") and not pre.get("add_prefix_space")
        added = spec.get("added_tokens") or []
        if not plain or any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in added):
            return None
        firsts = "".join(re.escape(c) for c in sorted({t["content"][0] for t in added}))
        return re.compile(rf" (?=[^\s{firsts}])")


class _Piece:
    """A ``sentencepiece`` file."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def __call__(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]

    def cut(self):
        return None


@lru_cache(maxsize=2)
def counter(path: str):
    return _Json(path) if path.endswith(".json") else _Piece(path)


class Pieces:
    """Counts of whole texts from the counts of their pieces, the short ones remembered."""

    def __init__(self, path: str):
        self.count = counter(path)
        self.cut = self.count.cut()
        self.known: dict[str, int] = {}

    def _learn(self, pieces) -> dict[str, int]:
        """Counts of pieces that are not known; long ones are not kept."""
        found, some, size = {}, [], 0
        for p in pieces:
            some.append(p)
            size += len(p)
            if size > 1 << 20:
                found.update(zip(some, self.count(some)))
                some, size = [], 0
        if some:
            found.update(zip(some, self.count(some)))
        self.known.update((p, n) for p, n in found.items() if len(p) <= PIECE_CHARS)
        return found

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        if self.cut is None:
            return self.count([text])[0]
        if len(self.known) > PIECES:                  # before the look-up, so that what is forgotten is new again
            self.known.clear()
        first, *rest = self.cut.split(text)
        rest = [" " + p for p in rest]
        rest.append(first)
        new = set(rest).difference(self.known)
        if new:
            found = self._learn(new)
            return sum(found[p] if p in found else self.known[p] for p in rest)
        return sum(map(self.known.__getitem__, rest))


def _encode(batches, path):
    """(digest, n_bytes, n_tokens) of every content, once for each task."""
    count, seen = Pieces(path), set()
    for batch in batches:
        digests = batch.column(0).to_pylist()
        rows, numbers = [], []
        for i, d in enumerate(digests):
            if d not in seen:
                seen.add(d)
                rows.append(i)
                numbers.append(count(W.text_column(batch, "text")[i].as_py()))
        if len(seen) > PIECES:
            seen.clear()
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(numbers, pa.int64())],
                                         ["digest", "n_bytes", "n_tokens"])


# ------------------------------------------------------------- the cache
class TokenCache:
    """Stored counts: a Parquet table in a folder that all executors share, partitioned by tokenizer digest."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        import uuid

        self.spark = spark
        self.path = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/quarry-token-cache-{uuid.uuid4().hex}"
        self._write(spark.createDataFrame([], _CACHE))           # an empty cache is a readable one

    def _write(self, counts: DataFrame) -> None:
        counts.write.mode("append").partitionBy("tokenizer").parquet(self.path)

    def counts(self, tokenizer: str) -> DataFrame:
        """digest, n_tokens of one tokenizer version: one row per content, also if two writers added it."""
        stored = self.spark.read.schema(_CACHE).parquet(self.path).filter(F.col("tokenizer") == tokenizer)
        return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def append(self, counts: DataFrame, tokenizer: str) -> None:
        """Add counts in one commit: a failed job leaves nothing that a reader sees."""
        self._write(counts.select("digest", "n_bytes", "n_tokens", F.lit(tokenizer).alias("tokenizer")))


def _row_hash(docs: DataFrame):
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, MapType)])


def count_tokens(docs: DataFrame, tokenizer: str, cache: TokenCache, text: str = "text", normalise=None) -> DataFrame:
    """Every row of ``docs`` without its text, with n_bytes (of the text) and n_tokens.

    ``tokenizer`` is the file's path, the same on every executor; ``normalise``
    (Column -> Column) maps texts to the content that is digested and encoded,
    as given by default.
    """
    version = tokenizer_digest(tokenizer)
    raw = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    content = normalise(raw) if normalise else raw
    keep = [c for c in docs.columns if c not in (text, "n_bytes", "n_tokens")]
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(None).cast("int").alias("_none"))
    digest = F.unhex(F.sha2(content, 256))
    size = F.octet_length(raw).cast("long")
    keys = staged(docs.select(row.alias("_row"), digest.alias("digest"), size.alias("n_bytes"), _row_hash(docs).alias("at")),
                  "token-keys")
    distinct = keys.groupBy("digest").agg(F.min("at").alias("at"))
    misses = staged(distinct.join(cache.counts(version), "digest", "left_anti").select("at").distinct(), "token-misses")
    picked = docs.select(_row_hash(docs).alias("at"), content.alias("text")).join(misses, "at", "left_semi")
    new = picked.select(F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"), "text") \
        .mapInArrow(partial(_encode, path=tokenizer), "digest binary, n_bytes long, n_tokens long")
    cache.append(new.groupBy("digest").agg(F.max("n_bytes").alias("n_bytes"), F.max("n_tokens").alias("n_tokens")), version)
    found = keys.join(cache.counts(version), "digest")
    return found.select(*([F.col("_row.*")] if keep else []), "n_bytes", "n_tokens")


def op13_token_counts(spark, sf_dir) -> DataFrame:
    """Bytes and tokens of every document by byte_bpe_50k.json, and whether they are more than 512."""
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, str(public_tokenizers.path("byte_bpe_50k.json")), TokenCache(spark))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))
