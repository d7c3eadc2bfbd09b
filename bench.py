"""Time the registered queries and the clip job; print one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (cores), BENCH_REPEAT (timed runs per
query, best counts), BENCH_CLIPS (clips for the media job, 0 to leave it out).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

import numpy as np  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from cliploom.operators import frames  # noqa: E402
from cliploom.plans import clip_job, decode_queries  # noqa: E402
from cliploom.plans.catalog import all_queries  # noqa: E402
from cliploom.session import build_session, drop_scratch  # noqa: E402
from cliploom.sources import media  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
REPEAT = int(os.environ.get("BENCH_REPEAT", "2"))
CLIPS = int(os.environ.get("BENCH_CLIPS", "200"))


def evaluate(df) -> None:
    """Compute every row and column, keep none."""
    df.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def bench_queries(spark) -> tuple[dict[str, float], dict[str, float]]:
    """Best time of each query, and the first time of those whose first run also writes the clip files."""
    best, writing = {}, {}
    for name, query in all_queries().items():
        folders = len(decode_queries._folders)
        runs = [timed(lambda q=query: evaluate(q.run(spark, SF_DIR))) for _ in range(REPEAT)]
        best[name] = round(min(runs), 3)
        if len(decode_queries._folders) > folders:
            writing[name] = round(runs[0], 3)
    return best, writing


def bench_media(spark, folder: Path) -> dict:
    """16 frames of 224x224 from each clip, normalised, in batches of tensors. Uncompressed input."""
    from media_files import write_y4m

    luma = np.random.default_rng(0).integers(16, 236, (32, 240, 320), dtype=np.uint8)
    for i in range(CLIPS):
        write_y4m(folder / f"part{i % 8}" / f"{i:05d}.mp4", luma, "420jpeg")

    def tensors() -> None:
        """Normalised frames, collated into batches and handed over, then reduced by the consumer."""
        batches = clip_job.collated(clip_job.clips(media.list_media(spark, str(folder))))
        evaluate(batches.select("batch_id", frames.mean_value(F.col("data")).alias("mean")))

    def means() -> None:
        """The same means without building a tensor."""
        evaluate(clip_job.batch_means(clip_job.clips(media.list_media(spark, str(folder)))))

    seconds = min(timed(tensors) for _ in range(REPEAT))
    return {
        "clips": CLIPS,
        "frames_per_clip": 16,
        "source": "y4m 320x240",
        "seconds": round(seconds, 3),
        "clips_per_sec": round(CLIPS / seconds, 2),
        "means_only_seconds": round(min(timed(means) for _ in range(REPEAT)), 3),
    }


def main() -> None:
    with tempfile.TemporaryDirectory(prefix="cliploom-bench-") as scratch:
        spark = build_session(
            "cliploom-bench",
            f"local[{CPUS}]",
            {
                "spark.sql.shuffle.partitions": str(CPUS),
                "spark.ui.enabled": "false",
                "spark.ui.showConsoleProgress": "false",
                "spark.driver.memory": "12g",
                "spark.checkpoint.dir": f"{scratch}/shared",
            },
        )
        spark.sparkContext.setLogLevel("ERROR")
        queries, writing = bench_queries(spark)
        clip_job_result = bench_media(spark, Path(scratch) / "media") if CLIPS else None
        if clip_job_result:
            queries["clip_job"] = clip_job_result["seconds"]
        result = {
            "metric": "total query time",
            "value": round(sum(queries.values()), 3),
            "unit": "sec",
            "queries": queries,
            "sf": float(os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf") or 0),
        }
        if clip_job_result:
            result["clip_job"] = clip_job_result
        result["with_writing_clips"] = writing
        drop_scratch(spark)
        spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
