"""Metadata folds and log replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import ADD_RUN, ADD_WAL, DROP_RUN, DROP_WAL, LEVELS, SET_NEXT
from ..plans.latest import by_window
from .visibility import global_positions


def fold_edits(edits: DataFrame) -> DataFrame:
    """State after all edits: ``kind`` (run or wal), ``id``, ``level``. The newest edit of each (kind, id) decides.

    Edits of an unknown op fail the fold, as a damaged metadata log must.
    """
    kind = F.when(F.col("op").isin(ADD_RUN, DROP_RUN), "run").when(F.col("op").isin(ADD_WAL, DROP_WAL), "wal").when(F.col("op") == SET_NEXT, "next")
    known = F.coalesce(F.col("op").isin(SET_NEXT, ADD_RUN, DROP_RUN, ADD_WAL, DROP_WAL), F.lit(False))
    edits = edits.withColumn("kind", F.when(known, kind).otherwise(F.concat(F.lit("x"), F.raise_error(F.lit("unknown metadata edit")).cast("string"))))
    newest = by_window(edits.where("kind <> 'next'"), keys=("kind", "id"), order="edit_seq")
    return newest.where(F.col("op").isin(ADD_RUN, ADD_WAL)).select("kind", "id", "level")


def next_file_number(edits: DataFrame) -> DataFrame:
    return edits.where(F.col("op") == SET_NEXT).agg(F.max_by("id", "edit_seq").alias("next_file_number"))


def valid_levels(state: DataFrame) -> DataFrame:
    """Runs of a level that exists; others are left out."""
    return state.where((F.col("kind") != "run") | F.col("level").between(0, LEVELS - 1))


def replay_order(wals: DataFrame) -> DataFrame:
    """Logs by numeric id (the replay order) beside their order as names."""
    return wals.select("wal", F.row_number().over(_order("wal")).alias("numeric_rank"), F.row_number().over(_order(F.col("wal").cast("string"))).alias("lexical_rank"))


def numbered_files(names: DataFrame) -> DataFrame:
    """``kind`` (run or wal) and ``id`` of files listed by ``name``; only stems of digits count, others are ignored."""
    stem = F.regexp_extract("name", r"^([0-9]+)\.(sst|wal)$", 1)
    kind = F.when(F.endswith("name", F.lit(".sst")), "run").otherwise("wal")
    return names.where(stem != "").select(kind.alias("kind"), stem.cast("long").alias("id")).distinct()


def runs_to_open(state: DataFrame, files: DataFrame) -> DataFrame:
    """``id`` and ``level`` of the runs to open: those of the metadata that lie on disk, at a level that exists.

    Metadata that names no run at all, at whatever level, makes every run on disk one of level 0; a run that is named but
    missing is skipped and does not bring that about.
    """
    named = state.where("kind = 'run'").select("id", "level")
    on_disk = files.where("kind = 'run'").select("id")
    any_named = F.broadcast(named.agg((F.count("*") > 0).alias("any_named")))  # one row
    listed = valid_levels(named.withColumn("kind", F.lit("run"))).select("id", F.col("level").cast("long").alias("level")).join(on_disk, "id", "left_semi")
    fallback = on_disk.crossJoin(any_named).where("not any_named").select("id", F.lit(0).cast("long").alias("level"))
    return listed.unionByName(fallback)


def logs_to_replay(state: DataFrame, files: DataFrame) -> DataFrame:
    """``id`` and ``found`` of logs: all that the metadata names or the folder holds; those not found are skipped by the replay."""
    on_disk = files.where("kind = 'wal'").select("id", F.lit(True).alias("found"))
    named = state.where("kind = 'wal'").select("id", F.lit(False).alias("found"))
    return on_disk.unionByName(named).groupBy("id").agg(F.bool_or("found").alias("found"))


def next_number_from_files(files: DataFrame) -> DataFrame:
    """The greatest number of any run or log on disk, 0 without any: where numbering goes on if the metadata is lost."""
    return files.agg(F.coalesce(F.max("id"), F.lit(0)).alias("next_file_number"))


def edits_to_log(state: DataFrame, proposed: DataFrame) -> DataFrame:
    """Those of the ``proposed`` edits (``op``, ``id``, ``level``) that change the metadata and are logged.

    Adding a log that is there, or dropping one that is not, changes nothing; edits of runs and numbers are always logged.
    """
    wals = state.where("kind = 'wal'").select("id", F.lit(True).alias("there"))
    met = proposed.join(wals, "id", "left").withColumn("there", F.coalesce("there", F.lit(False)))
    return met.where((F.col("op") == ADD_WAL) & ~F.col("there") | (F.col("op") == DROP_WAL) & F.col("there") | ~F.col("op").isin(ADD_WAL, DROP_WAL)).select(proposed.columns)


def _order(column):
    from pyspark.sql import Window

    return Window.orderBy(column)  # over log files: as many rows as the directory has logs


def replay(wal_records: DataFrame) -> DataFrame:
    """One mutation log from many: sequence numbers follow the numeric log id, then the place in the log."""
    return global_positions(wal_records, ["wal_id", "ordinal"]).select(F.col("pos").alias("seq"), "key", "op", "value")


def good_prefix(records: DataFrame, log: Column, order: Column, bad: Column) -> DataFrame:
    """Number of records before each log's first bad one (``wal``, ``n``); logs with none before it are left out."""
    rows = records.select(log.alias("wal"), order.alias("_at"), bad.alias("_bad"))
    first = rows.groupBy("wal").agg(F.min(F.when(F.col("_bad"), F.col("_at"))).alias("_stop"))
    return rows.join(first, "wal").where("_stop is null or _at < _stop").groupBy("wal").agg(F.count("*").alias("n"))
