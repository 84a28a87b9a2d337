"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from notemill.plans.catalogue import QUERIES
from notemill.session import local_session

HEADLINE = (
    "q_lines",
    "q_wikilinks",
    "q_dead_suggestions",
    "q_dead_by_type",
    "q_link_stats",
    "q_link_density",
    "q_zones_by_type",
    "q_edges",
    "q_orphans",
    "q_tag_cooc",
    "q_tag_suggest",
    "q_keywords",
    "q_quality",
    "q_title_jaccard",
    "q_mentions",
    "q_validation_summary",
    "q_vector_topk",
    "q_semantic_links",
    "q_event_windows",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "bench", spark__sql__shuffle__partitions=cores)
    took = {}
    QUERIES["q_lines"](spark, sf).write.format("noop").mode("overwrite").save()  # start-up is not a query's time
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
