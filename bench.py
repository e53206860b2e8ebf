"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the cores; names given as
arguments restrict the queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "b7_latest_samples", "c3_preprocess_chain", "c4_causal_notch", "c6_rms_envelope", "c8_instantaneous_phase",
    "c9_states_euler", "c11_extract_dynamics", "c14_evoked_response", "d1_welch_spectrum", "d2_band_powers",
    "d3_pairwise_coherence", "d6_encode_sliding", "e7_feature_vector", "f1_sliding_windows", "f3_assign_states",
    "g2_covariance_oas", "i5_sliding_quality", "i8_channel_summary", "j1_alpha_response", "k5_auc",
    "l6_classify_by_template", "m2_sliding_quality",
]


def main() -> None:
    from encephalake.plans.catalog import QUERIES
    from encephalake.session import get_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_session("bench", cores=os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    QUERIES["d2_band_powers"](spark, sf).write.format("noop").mode("overwrite").save()  # warm up
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total time of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
