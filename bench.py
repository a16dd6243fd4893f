"""Seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], as one line of JSON."""

from __future__ import annotations

import json
import os
import time

from anchorline.plans.queries import QUERIES
from anchorline.session import session

HEADLINE = ("chain_link_index", "yoy_contributions", "drawwise_chain", "drawwise_contributions", "fan_quantiles", "percentile_grid", "paired_impact_fan", "tax_layer_contrib", "crps", "var_fit", "gibbs_summary")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", spark__driver__memory="8g", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in (n for n in HEADLINE if n in QUERIES):
        times = []
        for _ in range(2):  # the second time the code is compiled
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(min(times), 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
