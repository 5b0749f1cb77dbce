"""Index a batch of code files.

``index_batch`` returns the batch's tables as lazy DataFrames (used by the
registered queries and by ``sources.store.write_index``, which materialises
them in lineage-cutting order).  Steps: F1/F2 language and rejects, X1-X3
extraction (C1-C3 inside), F3 empty-file rejects, F10 function rows, J2
edges, C4/C5/F11 vector rows + U1 embeddings, A1 file rows, A3 summary.

Contract: ``file_path`` is unique inside one batch (a later batch replaces an
earlier one).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import index as ix
from quarry.operators.extract import extract_functions
from quarry.operators.inference import DEFAULT_DIM, EmbedFn, embed
from quarry.operators.languages import split_empty, split_supported
from quarry.session import materialize


@dataclass
class IndexBatch:
    unsupported: DataFrame      # F2 rejects (400)
    empty: DataFrame            # F3 rejects (422)
    extracted: DataFrame        # X3 output of the accepted files
    files: DataFrame            # files-log rows
    rejected: DataFrame         # files-log rows of the F3 rejects (they count as uploads)
    functions: DataFrame        # functions-log rows (F10)
    edges: DataFrame            # call-edge rows (J2)
    vectors: DataFrame          # vector rows with embeddings (C4, C5, F11, U1)


def index_batch(files: DataFrame, ingest_seq: int, upload_time: str,
                embed_fn: EmbedFn | None = None, dim: int = DEFAULT_DIM,
                write_once: bool = False) -> IndexBatch:
    """``write_once``: write the extraction once to the shared checkpoint
    folder (it feeds five tables) instead of recomputing it per table."""
    accepted, unsupported = split_supported(files)
    extracted = extract_functions(accepted)
    if write_once:
        extracted = materialize(extracted, "extracted")
    kept, empty = split_empty(accepted, extracted)
    return IndexBatch(
        unsupported=unsupported,
        empty=empty,
        extracted=extracted,
        files=ix.file_rows(kept, extracted, ingest_seq, upload_time),
        rejected=ix.rejected_rows(empty, ingest_seq, upload_time),
        functions=ix.function_rows(extracted, ingest_seq),
        edges=ix.edge_rows(extracted, ingest_seq),
        vectors=embed(ix.vector_rows(extracted, ingest_seq), "document", embed_fn, dim),
    )


def summary(batch: IndexBatch) -> DataFrame:
    """A3 for one batch: one row per indexed file."""
    return ix.index_summary(batch.files, batch.extracted)


def union_logs(*batches: IndexBatch, tombstones: DataFrame | None = None):
    """Files, functions, edges and vector logs of several batches (in memory)."""
    def u(dfs):
        out = dfs[0]
        for d in dfs[1:]:
            out = out.unionByName(d)
        return out

    files = u([b.files for b in batches] + ([tombstones] if tombstones is not None else []))
    return (files, u([b.functions for b in batches]), u([b.edges for b in batches]),
            u([b.vectors for b in batches]))


def paths_of(files: DataFrame) -> DataFrame:
    return files.select(F.col("file_path"))
