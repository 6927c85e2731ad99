"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from attestor.plans import queries as own  # noqa: E402
from attestor.session import session  # noqa: E402

QUERIES = (
    "quote_verify", "normalise_views", "word_chunks", "char_chunks", "chunk_selection", "vector_topk", "line_offsets", "clause_units", "furniture_strip", "canonical_text", "exact_dup_align", "bigram_dice",
    "materiality_floor", "key_terms", "search_analytics", "tumbling_rate", "conversation_nested", "coverage_fold", "ring_buffer",
)


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    out = sys.stdout
    sys.stdout = sys.stderr
    spark = session("bench", **{
        "spark.master": f"local[{cpus}]", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"), "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="spark-"),
    })
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{path}/nation.parquet").count()
    took, failed = {}, {}
    for name in QUERIES:
        began = time.time()
        try:
            own.QUERIES[name](spark, path).write.format("noop").mode("overwrite").save()
        except Exception as e:  # one query that fails must not cost the figures of the others
            failed[name] = f"{type(e).__name__}: {e}"[:300]
            continue
        took[name] = round(time.time() - began, 3)
    spark.stop()
    result = {"metric": "total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": path.rstrip("/").rpartition("sf")[2]}
    print(json.dumps(result | ({"failed": failed} if failed else {})), file=out)
    if failed:
        sys.exit(1)


if __name__ == "__main__":
    main()
