"""S3: index code files as they arrive in a folder (Structured Streaming).

``readStream.format("binaryFile")`` picks up new files; each micro-batch is
indexed by ``write_index`` inside ``foreachBatch``.  Its sequence is claimed in
the store under the stream's own id (the one in its checkpoint) and the
micro-batch's number: a batch that Spark replays after a failure gets the same
sequence and upload time, writes a new attempt and replaces the earlier one at
its commit row; a second stream or a fresh checkpoint gets sequences of its own,
so no stream overwrites another's batches.  A newer upload of a path hides the
older one through the files log.  No Spark state is kept beyond the source
offsets in ``checkpoint_location``.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from quarry.operators.inference import DEFAULT_DIM, EmbedFn
from quarry.sources import store as S


BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def _stream_id(spark: SparkSession, checkpoint_location: str) -> str:
    """The id that Spark keeps in the checkpoint: the same after a restart, another for a fresh checkpoint."""
    text = spark.read.text(f"{checkpoint_location.rstrip('/')}/metadata", wholetext=True).first()[0]
    return json.loads(text)["id"]


def ingest_stream(spark: SparkSession, source_dir: str, store_path: str, checkpoint_location: str,
                  glob: str | None = None, seq_base: int = 1_000_000,
                  embed_fn: EmbedFn | None = None, dim: int = DEFAULT_DIM,
                  available_now: bool = True, max_files_per_trigger: int | None = None):
    """Start the ingest query; with ``available_now`` it processes what is
    there and stops (``awaitTermination`` returns).  Returns the query."""
    reader = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
              .option("recursiveFileLookup", "true"))
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    stream = reader.load(source_dir).select("path", "content")

    def index_batch(batch: DataFrame, batch_id: int) -> None:
        files = S._decode(batch, source_dir)
        now = datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
        seq, time = S.claim_sequence(batch.sparkSession, store_path, _stream_id(spark, checkpoint_location), batch_id, now, seq_base)
        if S.is_settled(batch.sparkSession, store_path, seq):      # a replay of a batch that was compacted meanwhile
            return
        S.write_index(batch.sparkSession, files, store_path, seq, time, embed_fn, dim)

    writer = (stream.writeStream.foreachBatch(index_batch)
              .option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
