"""cliploom: clip and frame preparation as Spark DataFrames.

The public surface is a handful of modules; every function takes and returns
DataFrames (or Columns):

* ``media``    list files, probe headers
* ``frames``   sample, fan out, decode, resize, normalise
* ``clips``    stack frames into tensors, per-clip values
* ``batches``  dense index, batch ids, collate, shuffle, map over batches
* ``dataset``  save, load, incremental reprocessing, preload
* ``runs``     analytics over a log of benchmark runs
"""

from cliploom.operators import batches, clips, frames, runs
from cliploom.session import build_session, shared_dir, ship_package
from cliploom.sources import dataset, media

__all__ = ["batches", "build_session", "clips", "dataset", "frames", "media", "runs", "shared_dir", "ship_package"]
