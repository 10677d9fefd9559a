"""The data model: a mutation log of (seq, key, op, value), runs of it by level, and metadata edits."""

from __future__ import annotations

from pyspark.sql import types as T

VALUE, TOMBSTONE = 1, 2
#: Fixed values of the engine that results depend on.
ROTATION_KEYS = 10_000  # distinct keys that close a memory table
LEVEL0_TRIGGER = 2  # level-0 runs that start a compaction
LEVELS = 2
BLOCK_BYTES = 4096  # a block that has reached this size is closed before the next entry
CHECKPOINT_EDITS = 100
ENTRY_MEMORY = 128  # bytes that the memory estimate counts for an entry
SET_NEXT, ADD_RUN, DROP_RUN, ADD_WAL, DROP_WAL = 1, 2, 3, 4, 5

LOG = T.StructType([T.StructField("seq", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("op", T.ByteType()), T.StructField("value", T.BinaryType())])
WAL = T.StructType([T.StructField("wal_id", T.LongType()), T.StructField("ordinal", T.LongType()), T.StructField("op", T.ByteType()), T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType())])
EDITS = T.StructType([T.StructField("edit_seq", T.LongType()), T.StructField("op", T.ByteType()), T.StructField("id", T.LongType()), T.StructField("level", T.LongType())])
COMMANDS = "conn_id long, generation long, req_seq long, argv array<string>"
