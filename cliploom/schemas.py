"""Row layouts shared by the operators. Declared, never inferred."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

CLIPS = (
    "video_idx bigint, video_path string, video_name string, video_size bigint, "
    "total_frames bigint, fps double, width int, height int, status string, error string"
)

# One row per sampled frame; ``data`` holds height*width*channels unsigned bytes.
FRAMES = (
    "video_idx bigint, video_path string, video_name string, video_size bigint, k int, frame_idx bigint, height int, width int, "
    "channels int, layout string, data binary, status string, error string"
)

# One row per clip; ``data`` is the concatenation of its frames in order of k.
TENSORS = (
    "video_idx bigint, video_path string, video_name string, video_size bigint, n_frames int, height int, width int, channels int, "
    "dtype string, layout string, data binary, frame_count int, status string, error string"
)

# One row per batch: normalised frames as (batch_size, n_frames, channels, height, width).
BATCHES = (
    "batch_id bigint, batch_size int, n_frames int, height int, width int, channels int, dtype string, "
    "layout string, data binary, video_paths array<string>, video_names array<string>, statuses array<string>"
)

# What is left of a clip when its pixels are reduced in the decode task.
CLIP_MEANS = (
    "video_idx bigint, video_path string, video_name string, video_size bigint, "
    "frame_count int, status string, error string, mean_value double"
)

RUNS = (
    "name string, framework string, method string, run_no bigint, num_workers int, batch_size int, "
    "total_time double, samples_processed bigint, samples_per_second double, "
    "memory_usage_mb double, peak_memory_mb double, success boolean, error string"
)

# Frame status, from best to worst. The worst status of its frames is the clip's.
OK = "ok"
ZERO_FILLED = "zero_filled"  # one frame could not be read: zero before normalisation
EMPTY = "empty"  # clip without frames: zero before normalisation, not an error
ERROR = "error"  # clip could not be opened: zero after normalisation, frame_count 0
SEVERITY = (OK, ZERO_FILLED, EMPTY, ERROR)


def arrow(layout: str) -> pa.Schema:
    """Arrow form of a layout, with any types that Spark can hand to Arrow. Call it on the driver."""
    return to_arrow_schema(StructType.fromDDL(layout))


def arrow_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)
