"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from lumitie.session import build_session

# k1_detections is timed from raw; later queries read the staged phase outputs, and the
# first one that needs a phase pays for it.
HEADLINE = ("k1_detections", "a1_star_means", "t15_node_positions", "a11_edges", "g6_connectivity",
            "l1_normal_matrix", "l2_gray_matrix", "l10_unanchored", "l6_anchored", "l11_gray_solve",
            "i1_residuals", "i4_apply_flags", "a14_star_flat", "m6_starflat_fit", "i9_catalog",
            "j9_sky_match", "m2_gaia_detrend", "v0_fgcm_rms", "v1_repeatability", "v4_gaia_comparison",
            "v7_ps1_comparison", "a20_quantiles", "i5_outlier_loop")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", cpus, "bench", memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    from lumitie.plans.registry import QUERIES

    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    only = sys.argv[1:] or HEADLINE
    times = {}
    for name in only:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total wall time of the headline queries", "unit": "sec",
                      "value": round(sum(times.values()), 3), "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
