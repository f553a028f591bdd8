"""Change capture over a stream of raw files: each micro-batch is one run of the batch operators.

Reference state lives in a versioned table, not in the stream's state store: it outlives the query, is shared with batch
runs, and has no watermark after which a key would be forgotten.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.operators import cdc
from weirflow.operators.normalize import PROVIDER, normalize, split_pending
from weirflow.schema import SEEN
from weirflow.sources.buckets import Bucketed
from weirflow.sources.store import Files


def capture_stream(spark: SparkSession, source: str, schema: T.StructType, state_root: str, delta_path: str, checkpoint: str, now: str, provider: str = PROVIDER) -> int:
    """Process all files that are there, then stop; returns the number of batches. Rows that are still pending are left out.

    The delta of a batch is written first, then the state, with the batch's number among its notes. A batch that is run
    again after that is known from the note, and left alone: its delta is there already. One that is run again before, from
    the same state, writes the same delta over. So each change is put out once, wherever a run was cut off.
    """
    state = Bucketed(spark, f"{state_root}/seen", SEEN)
    batches = []

    def one(raw: DataFrame, batch: int) -> None:
        # The stream's own id, kept in its checkpoint: a stream begun anew counts its batches from 0 again.
        stream = f"stream-{json.loads(Files(spark).read(f'{checkpoint}/metadata') or '{}').get('id')}"
        if state.notes().get(stream, -1) >= batch:
            return
        final, _ = split_pending(raw)
        classified = cdc.keyed_against(normalize(final, provider), state.read(), buckets=state.buckets).persist()
        try:
            delta = cdc.exported(classified)
            delta.write.mode("overwrite").parquet(f"{delta_path}/batch={batch}")
            state.merge(delta, lambda old, new: cdc.upsert_seen(old, new, F.lit(now).cast("timestamp")), {stream: batch})
        finally:
            classified.unpersist()
            state.close()
        batches.append(batch)

    query = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(batches)
