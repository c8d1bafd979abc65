"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (names between commas; default the headline queries).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from weft import plans  # noqa: E402
from weft.session import local_session  # noqa: E402

HEADLINE = [
    "diverse_top3",
    "block_code_stats",
    "lines_numbered",
    "vocab_counts",
    "vocab_build",
    "vocab_limit",
    "encode_tokens",
    "oov_rate",
    "make_target",
    "unlabelled_rows",
    "hash_codes",
    "hash_projected",
    "bleu_stats",
    "self_bleu_words",
    "diversity_report",
    "arm_comparison",
    "tree_nodes",
    "tree_encoded",
    "train_valid_split",
    "token_batches",
    "bootstrap_pad",
    "metric_best_so_far",
    "normalise_punct",
    "truecase_apply",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus, "weft-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = plans.queries()

    def run(name: str) -> float:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - began, 3)

    # The first run compiles; the second one is counted, with everything it has to read.
    first = {name: run(name) for name in names}
    seconds = {name: run(name) for name in names}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "first_run": first,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
