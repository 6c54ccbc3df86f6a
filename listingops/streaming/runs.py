"""Running streams over arrivals: a folder that is watched, a query that catches up and stops, its output as a table."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listingops.sources.stored import shared_dir

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started within keep their state in RocksDB, outside the heap; the session's own choice returns after."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


def catch_up(parts: Sequence[DataFrame], make: Callable[[DataFrame], DataFrame], name: str, mode: str = "append", writer: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """What make(stream) puts out once all parts have arrived, one after the other.

    Each part is appended to a watched folder; the query then reads what is there and stops, and at the next part it goes
    on from its checkpoint, as a scheduled job does. Folder, checkpoint and output lie in the shared folder. mode append
    writes files that the sink commits once; mode update writes each batch's rows to a folder of its own, with the
    column batch, which a repeated batch overwrites (see latest). With a foreachBatch writer there is no output.
    """
    spark, schema = parts[0].sparkSession, parts[0].schema
    home = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/out/batch={batch_id}")

    shape = None
    for part in parts:
        part.write.mode("append").parquet(f"{home}/in")
        made = make(spark.readStream.schema(schema).parquet(f"{home}/in"))
        shape = made.schema
        sink = made.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True)
        with rocksdb(spark):
            if mode == "append" and writer is None:
                running = sink.format("parquet").start(f"{home}/out")
            else:
                running = sink.foreachBatch(writer or put).start()
        running.awaitTermination()
    if writer is not None:
        return None
    return spark.read.schema(shape if mode == "append" else shape.add("batch", "long")).parquet(f"{home}/out")


def latest(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The last row that each key was given in the output of mode update."""
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = F.max_by(F.struct(*values), "batch").alias("_x")
    return rows.groupBy(*keys).agg(newest).select(*keys, "_x.*")
