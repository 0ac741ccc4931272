"""Incremental jobs on Structured Streaming.

ST1 ``ingest_memory``: finished translations arrive as files; every
micro-batch is appended to the TM table under ``batch_id=<n>`` (overwrite of
that folder only, so a retried batch is idempotent). Readers see the TM as
``upsert_latest`` over all batches: the highest ``seq`` per id wins, which
does not depend on arrival order, so any batches may be folded beforehand.
``fold_batches`` does that: it writes the settled rows of batches a to b as a
run ``_folded/run=a-b``. The names of the runs are the ledger of what is
settled: readers take the runs and only the batches after them, and a run
counts once its write has ended (its ``_SUCCESS`` file is there), so a fold
that dies halfway changes nothing and is repeated as a whole.

ST2 ``stream_missing``: source entries arrive as files; each micro-batch is
anti-joined with the (static) target keys and appended to the output.
There is no event time in catalogs, so no watermark is needed: the join is
stream-static.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.catalog import missing_entries
from ..operators.memory import upsert_latest
from ..schemas import ENTRY_KEYS


def _run(stream: DataFrame, handler, checkpoint: str, available_now: bool = True):
    w = stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q


BATCH_BYTES = 256 << 30  # a micro-batch ends at this many bytes of new files; memory does not depend on it


def _arriving(spark: SparkSession, source_path: str, schema, files_per_batch: int | None) -> DataFrame:
    r = spark.readStream.schema(schema)
    r = r.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else r.option("maxBytesPerTrigger", BATCH_BYTES)
    return r.parquet(source_path)


def ingest_memory(spark: SparkSession, source_path: str, table_path: str, checkpoint: str,
                  schema, files_per_batch: int | None = None, available_now: bool = True):
    """ST1: stream TM rows from ``source_path`` (Parquet files) into the TM table at ``table_path``."""
    stream = _arriving(spark, source_path, schema, files_per_batch)

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table_path}/batch_id={batch_id}")

    return _run(stream, handle, checkpoint, available_now)


def _complete(spark: SparkSession, root: str, prefix: str) -> list[str]:
    """What follows ``prefix`` in the names of the completely written folders of ``root``."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
    return [n[len(prefix):] for n in names if n.startswith(prefix)
            and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS"))]


def table_state(spark: SparkSession, table_path: str) -> tuple[list[tuple[int, int]], list[int]]:
    """The runs that settle the longest row of batches from 0 on, and the batches after them."""
    ends: dict[int, int] = {}
    for name in _complete(spark, f"{table_path}/_folded", "run="):
        first, last = map(int, name.split("-"))
        ends[first] = max(last, ends.get(first, last))
    runs, nxt = [], 0
    while nxt in ends:
        runs.append((nxt, ends[nxt]))
        nxt = ends[nxt] + 1
    return runs, sorted(int(b) for b in _complete(spark, table_path, "batch_id=") if int(b) >= nxt)


def _run_path(table_path: str, run: tuple[int, int]) -> str:
    return f"{table_path}/_folded/run={run[0]}-{run[1]}"


def read_memory(spark: SparkSession, table_path: str) -> DataFrame:
    """The settled TM: latest write per id over the runs and every later batch."""
    runs, batches = table_state(spark, table_path)
    paths = [_run_path(table_path, r) for r in runs] + [f"{table_path}/batch_id={b}" for b in batches]
    return upsert_latest(spark.read.parquet(*(paths or [table_path])))


def fold_batches(spark: SparkSession, table_path: str, fan: int = 8) -> list[tuple[int, int]]:
    """Settle the batches that no run holds yet as a new run; returns the runs then in force.

    The batches from the first unsettled one up to the first gap are folded;
    the older runs are left alone until there are more than ``fan``, which
    are then folded into one. A row is thus rewritten once in ``fan`` folds,
    not in each. Only one fold of a table may run at a time; the stream may
    go on meanwhile. Folded batches are deleted by ``drop_folded``.
    """
    runs, batches = table_state(spark, table_path)
    first = runs[-1][1] + 1 if runs else 0
    todo = [b for i, b in enumerate(batches) if b == first + i]
    if todo:
        run = (first, todo[-1])
        rows = spark.read.parquet(*[f"{table_path}/batch_id={b}" for b in todo])
        upsert_latest(rows).write.mode("overwrite").parquet(_run_path(table_path, run))
        runs.append(run)
    if len(runs) > fan:
        whole = (0, runs[-1][1])
        rows = spark.read.parquet(*[_run_path(table_path, r) for r in runs])
        upsert_latest(rows).write.mode("overwrite").parquet(_run_path(table_path, whole))
        runs = [whole]
    return runs


def drop_folded(spark: SparkSession, table_path: str) -> int:
    """Delete the batches and runs that a run in force has replaced; returns how many. No reader may still use them."""
    runs, _ = table_state(spark, table_path)
    last = runs[-1][1] if runs else -1
    kept = {f"{a}-{b}" for a, b in runs}
    old = [f"{table_path}/batch_id={b}" for b in _complete(spark, table_path, "batch_id=") if int(b) <= last]
    old += [f"{table_path}/_folded/run={r}" for r in _complete(spark, f"{table_path}/_folded", "run=")
            if r not in kept and int(r.split("-")[1]) <= last]
    jvm = spark.sparkContext._jvm
    for p in old:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return len(old)


def stream_missing(spark: SparkSession, source_path: str, target: DataFrame, out_path: str, checkpoint: str,
                   schema, langs: list[str] | None = None, files_per_batch: int | None = None,
                   available_now: bool = True):
    """ST2: for each arriving batch of source entries, append the ones missing from ``target``."""
    stream = _arriving(spark, source_path, schema, files_per_batch)
    tkeys = target.select(*ENTRY_KEYS).distinct()

    def handle(batch: DataFrame, batch_id: int) -> None:
        missing_entries(batch, tkeys, langs).write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    return _run(stream, handle, checkpoint, available_now)


def read_missing(spark: SparkSession, out_path: str) -> DataFrame:
    return spark.read.parquet(out_path).drop("batch_id")


def land_in_files(df: DataFrame, path: str, n_files: int, order_col: str | None = None) -> None:
    """Write ``df`` as ``n_files`` Parquet files (the arrival stream of a test or backfill)."""
    out = df.repartitionByRange(n_files, order_col) if order_col else df.repartition(n_files)
    out.write.mode("overwrite").parquet(path)



def compact_memory(spark: SparkSession, table_path: str, out_path: str) -> None:
    """Fold every ingested batch into a ``lang``-partitioned TM table (latest write per id).

    Run on a schedule: readers of ``out_path`` then scan one row per id and
    can prune by language instead of aggregating every batch.
    """
    from ..sources.memory_store import write_memory
    settled = read_memory(spark, table_path)
    if "embedding" not in settled.columns:
        from pyspark.sql import functions as F
        settled = settled.withColumn("embedding", F.lit(None).cast("array<float>"))
    write_memory(settled, out_path, mode="upsert")
