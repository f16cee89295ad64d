"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the local cores. Each query is run to
the end into a sink that discards rows, so transfer to Python is not timed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from terraweave.plans.registry import QUERIES  # noqa: E402
from terraweave.session import local_session  # noqa: E402

HEADLINE = [
    "w01_sentence_segment", "w03_windows_fixed", "x06_extract_triples", "f03_validate_triples", "m01_cue_mapping",
    "a05_graph_edges", "a05_graph_nodes", "d06_top_connected", "a01_graph_summary", "v07_two_hop_neighbours",
    "w05_token_chunks", "p14_token_offsets", "x02_parse_and_validate", "a06_entity_registry", "j08_mention_positions",
    "m11_canonical_resolve", "a08_relation_dedup", "i13_graph_commit", "g17_geo_edges", "g18_anchor_edges",
    "m14_constraint_specs", "f15_constraint_prune", "a23_total_energy", "i08_grounding_fold", "a14_credible_ellipse",
    "a16_gelman_rubin", "a17_effective_sample_size", "a18_constraint_satisfaction", "i03_metropolis",
    "a10_score_lenient", "d09_rolling_eta", "t04_stream_counts",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor before timing
    times = {}
    for name in HEADLINE:
        t0 = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
