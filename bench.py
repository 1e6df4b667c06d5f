"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}.
Each query is executed in full with the no-op sink (nothing is collected to the driver).
Before timing, one small job unrelated to the headline queries (a range aggregation and a
Parquet footer read) starts the executors and JIT, so that fixed start-up cost is not
charged to whichever query happens to run first.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "sent_bleu4", "bleu_stats_pair", "sim_bleu", "bleu_from_maps", "bleu_cli", "bleu_corpus_smoothed",
    "ngram_count", "nist_tokens", "encode_ids", "decode_ids", "frame_cls_sep_mask", "vocab_doc_size",
    "next_token_table", "beam_search", "beam_search_words", "greedy_decode", "running_loss", "token_weighted_loss_ppl",
    "best_checkpoint", "src_zip_lines", "dev_sample", "l2_normalize",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("seqforge-bench")
             .config("spark.sql.shuffle.partitions", str(int(cpus) * 2))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "16g"))
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from seqforge.session import checkpoint_dir
    checkpoint_dir(spark)   # the session's shared folder; a private one only if none is configured
    from seqforge.plans import catalog  # noqa: F401
    from seqforge.plans.registry import REGISTRY
    spark.range(0, 2_000_000, 1, int(cpus)).selectExpr("sum(id % 7)").collect()        # warm-up only
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    times = {}
    for n in names:
        t0 = time.time()
        df = REGISTRY[n].fn(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
        print(f"# {n}: {times[n]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_wall", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
