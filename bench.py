"""Times the headline queries and prints one JSON line.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]. Every query
runs once to warm up (and to learn the tables that it needs) and then $BENCH_RUNS times
(default 3); the median counts. Results are written to Spark's no-op sink, so every output
column is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from lumisync.operators.embed import embed
from lumisync.operators.encoders import GridImageEncoder
from lumisync.plans.fixtures import photo_files
from lumisync.plans.registry import QUERIES
from lumisync.session import local_session
from lumisync.sources.scan import scan_images

PHOTOS = 1_025

HEADLINE = (
    "vector_topk", "vector_topk_native", "batch_topk", "batch_topk_blocks", "full_ranking", "text_search",
    "contrastive_loss", "snapshot_diff", "sync_store", "filter_exclude", "scan_files",
    "embed_batch", "embed_text", "text_pretokenize", "bpe_encode", "token_ids",
    "bench_summary", "linear_probe",
)


def run(query, spark, sf_dir: str) -> float:
    started = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def time_photos(spark, runs: int) -> float:
    """Scan, decode, resize to 224 and embed filtered PNG files of 256 pixels and more."""
    root = photo_files(spark, PHOTOS)
    seconds = []
    for _ in range(runs + 1):
        started = time.perf_counter()
        embed(scan_images(spark, root), "path", GridImageEncoder()).write.format("noop").mode("overwrite").save()
        seconds.append(time.perf_counter() - started)
    return statistics.median(seconds[1:])


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        run(QUERIES[name], spark, sf_dir)
        seconds[name] = round(statistics.median(run(QUERIES[name], spark, sf_dir) for _ in range(runs)), 3)
    seconds["embed_photos_224"] = round(time_photos(spark, runs), 3)
    rows = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet").count()
            for n in ("orders", "documents", "supplier", "embeddings", "customer")}
    rates = {
        "diff_rows_per_sec": rows["orders"] / seconds["snapshot_diff"],
        "sync_rows_per_sec": rows["orders"] / seconds["sync_store"],
        "scan_files_per_sec": rows["customer"] / seconds["scan_files"],
        "embed_images_per_sec": rows["supplier"] / seconds["embed_batch"],
        "embed_photos_per_sec": PHOTOS / seconds["embed_photos_224"],
        "pretokenize_docs_per_sec": rows["documents"] / seconds["text_pretokenize"],
        "batch_scores_per_sec": 2 * rows["embeddings"] ** 2 / seconds["batch_topk"],
    }
    print(json.dumps({
        "metric": "total_headline_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cores": spark.sparkContext.defaultParallelism,
        "rates": {k: round(v, 1) for k, v in rates.items()},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
