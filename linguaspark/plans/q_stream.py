"""Registered incremental (streaming) queries; each returns the settled state."""

from __future__ import annotations

from ..session import new_work_path
from ..streaming.incremental import (fold_batches, ingest_memory, land_in_files, read_memory, read_missing,
                                     stream_missing)
from . import fixtures as fx
from .q_catalog import _NOT_IN_TGT
from .q_memory import _WRITES_SQL, tm_writes
from .registry import register
from .sql_fixtures import SRC_DUP, TGT_DUP, with_


@register("stream_tm_ingest", _WRITES_SQL + """
select * from w qualify row_number() over (partition by id order by seq desc) = 1""")
def stream_tm_ingest(spark, sf):
    """TM writes arrive as 4 files; the stream appends each batch, readers see the latest per id."""
    rows = tm_writes(spark, sf)
    base = new_work_path(spark, "stream-tm")
    land_in_files(rows, f"{base}/in", 4, "seq")
    ingest_memory(spark, f"{base}/in", f"{base}/table", f"{base}/ckpt", rows.schema, files_per_batch=1)
    return read_memory(spark, f"{base}/table")


@register("stream_tm_fold", _WRITES_SQL + """
select * from w qualify row_number() over (partition by id order by seq desc) = 1""")
def stream_tm_fold(spark, sf):
    """Ingest the first writes, fold their batches, ingest the revisions: readers take the run and the later batches."""
    rows = tm_writes(spark, sf)
    base = new_work_path(spark, "stream-fold")
    for name, part in (("first", rows.where("seq < 1000000000")), ("revised", rows.where("seq >= 1000000000"))):
        land_in_files(part, f"{base}/in/{name}", 2, "seq")
        ingest_memory(spark, f"{base}/in/*", f"{base}/table", f"{base}/ckpt", rows.schema, files_per_batch=1)
        if name == "first":
            fold_batches(spark, f"{base}/table")
    return read_memory(spark, f"{base}/table")


@register("stream_missing", with_(src=SRC_DUP, tgt=TGT_DUP) + f"""
select s.catalog, 'ja' as lang, s.key, s.value, s.ord from src s where {_NOT_IN_TGT}""")
def stream_missing_keys(spark, sf):
    """Source entries arrive as 4 files; each batch is anti-joined with the target catalogs."""
    src = fx.source_entries_dup(spark, sf)
    base = new_work_path(spark, "stream-missing")
    land_in_files(src, f"{base}/in", 4, "ord")
    stream_missing(spark, f"{base}/in", fx.target_entries_dup(spark, sf), f"{base}/out", f"{base}/ckpt",
                   src.schema, ["ja"], files_per_batch=1)
    return read_missing(spark, f"{base}/out").select("catalog", "lang", "key", "value", "ord")
