"""Incremental judgement ingestion (the reference appends judge decisions to
qrels text files while a run is in progress).

Structured Streaming picks up new qrels files in a folder, parses them with
the same function as the batch reader and appends the typed judgements to a
parquet table.  Progress is tracked in a checkpoint under the cluster's
shared ``spark.checkpoint.dir``, so a restarted or partially failed job
neither loses nor duplicates files (file source + file sink = exactly once).
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from relkit.session import ensure_checkpoint_dir
from relkit.sources.trec import parse_qrels


def start_judgement_ingest(spark: SparkSession, in_dir: str, out_dir: str, name: str = "qrels_ingest",
                           available_now: bool = True) -> StreamingQuery:
    """Start the stream; ``available_now`` processes what is there and stops
    (batch-like catch-up), otherwise it keeps polling the folder."""
    lines = spark.readStream.format("text").load(in_dir)
    judgements = parse_qrels(lines).drop("relevancy_raw")
    ckpt = os.path.join(ensure_checkpoint_dir(spark), "streams", name)
    w = (judgements.writeStream.format("parquet").option("path", out_dir)
         .option("checkpointLocation", ckpt).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
