"""Incremental runs: a stream of items against a ledger of ids that are done."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from easel.plans.ship import ship

_STORE = "spark.sql.streaming.stateStore.providerClass"
_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ids done so far, once each; a ledger that isn't there yet is empty."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "id string")
    return spark.read.schema("id string, batch string").parquet(path).select("id").distinct()


class FirstSeen(StatefulProcessor):
    """Lets the first item of each id through, unless the ledger has the id. The state is whether the ledger has it; a row
    without an item says that the id failed, which opens it again."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        failed, first = False, None
        for f in rows:
            there = f["item"].notna()
            failed = failed or not there.all()
            first = f["item"][there].iloc[0] if first is None and there.any() else first
        if failed and self.seen.exists() and not self.seen.get()[0]:
            self.seen.clear()
        if first is not None and not self.seen.exists():
            self.seen.update((False,))
            yield pd.DataFrame({"item": [first]})

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.seen.update((True,))


def ledger_stream(spark: SparkSession, source: str, schema: StructType, ledger: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], output: str, id: str = "id", batch_files: int = 100) -> None:
    """Process what is new at source, once: items whose id isn't in the ledger go through work, which returns them
    with ok; results are written to output, and ids that succeeded to the ledger.

    What came by is keyed state in RocksDB. A new checkpoint takes the ledger in as its first state, so the ledger is read
    once a checkpoint, not once a batch, and a batch costs what it brings. Output and ledger get a folder for each batch,
    overwritten if the batch is run again, for which the state is the one before it; so a replay neither adds nor loses
    rows. Ids that failed go to a folder beside the ledger, which later runs stream as well: such an id goes through again
    when it comes again, or by a new checkpoint. Rows without an id are left out; of several rows of an id in a batch one
    goes through.
    """
    ship(spark)
    at = spark._jvm.org.apache.hadoop.fs.Path(source)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", batch_files)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():  # streams read folders
        items = reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    else:
        items = reader.parquet(source)
    failures = f"{ledger.rstrip('/')}-failed"
    p = spark._jvm.org.apache.hadoop.fs.Path(failures)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)
    # an item goes through the state as one string, as pandas would turn whole numbers with gaps into floats
    packed = F.to_json(F.struct(*[F.col(f"`{c}`") for c in items.columns]), _EXACT)
    keyed = items.where(F.col(id).isNotNull()).select(F.col(id).cast("string").alias("done_id"), packed.alias("item"))
    marks = spark.readStream.schema("id string").parquet(failures).select(F.col("id").alias("done_id"), F.lit(None).cast("string").alias("item"))
    keyed = keyed.unionByName(marks)
    done = read_ledger(spark, ledger).select(F.col("id").alias("done_id"))
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        new = keyed.groupBy("done_id").transformWithStateInPandas(statefulProcessor=FirstSeen(), outputStructType="item string", outputMode="Append", timeMode="None", initialState=done.groupBy("done_id"))

        def one(batch: DataFrame, n: int) -> None:
            tag = f"{zlib.crc32(checkpoint.encode()):08x}-{n}"
            work(batch.select(F.from_json("item", schema, _EXACT).alias("item")).select("item.*")).write.mode("overwrite").parquet(f"{output}/batch={tag}")
            written = batch.sparkSession.read.parquet(f"{output}/batch={tag}")
            ended = written.select(F.col(id).cast("string").alias("id"), F.coalesce("ok", F.lit(False)).alias("ok"))
            ended.where("ok").select("id").write.mode("overwrite").parquet(f"{ledger}/batch={tag}")
            ended.where("not ok").select("id").write.mode("overwrite").parquet(f"{failures}/batch={tag}")

        new.writeStream.foreachBatch(one).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_STORE, before)
