"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from vigilake.plans import QUERIES
from vigilake.session import local_session

HEADLINE = (
    "parse_event_verbatim", "case_events", "smq_lookup", "section_16_1_table", "narrative_keyword",
    "content_hash", "latest_date_records", "search_drugs", "product_lookup_cascade",
    "candidate_scoring", "process_blocks", "section_carry_forward", "html_elements",
    "parse_label_date", "latest_document",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = local_session(cores, partitions=max(cores, 8), app="bench")
    QUERIES["search_drugs"](spark, sf_dir).collect()  # JVM warm-up
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
