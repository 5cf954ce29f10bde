"""Keep a full-text index of documents up to date: takes new Parquet files of documents, rewrites the segments they touch.

The folder of documents is a file stream; its checkpoint knows which files were taken, so a run takes new ones only and ends
when there are none.  A file may bring new documents or new texts of known ones.  Each batch replaces its documents in the
index by dynamic partition overwrite, so a batch that is run again after a failure changes nothing more.

    python -m jobs.index_documents --documents PATH --index PATH --checkpoint PATH
"""

from __future__ import annotations

import os
import sys

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession

from jobs import common
from mossgraph.operators import postings
from mossgraph.streaming import jobs as streams


def run(spark: SparkSession, documents: str, index: str, checkpoint: str, most_files: int = 64) -> DataFrame:
    """Take new files of documents (doc_id, text) into the index; returns the index as it then stands."""

    def take(batch: DataFrame, n: int) -> None:
        read = batch.select("doc_id").count()
        common.log.info("index_documents: batch %d read %d documents from %s", n, read, documents)
        if read:
            postings.updated(batch.sparkSession, index, batch.select("doc_id", "text"))
            common.log.info("index_documents: batch %d wrote their segments to %s", n, index)

    stream = streams.stream_of(spark, documents, int(most_files))
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return postings.opened(spark, index)


if __name__ == "__main__":
    common.main(run, __doc__, __file__)
