"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; one JSON line.

Each query is built and fully computed twice (all columns, no output); the second time counts.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "crossmatch", "dup_flags", "nearest_any", "tile_matched", "tile_unmatched", "tile_crossmatched",
    "merge_tiles", "match_distance", "three_survey_matched", "three_survey_unmatched",
    "hist1d_density", "hist2d_colours", "corr_matrix", "sigma_eta", "weights_band", "weights_mean",
    "colours", "impute_median", "folds_shuffled_exact", "shuffle_column", "arcsinh_stretch",
    "predict_rf", "predict_lasso", "predict_krr", "validate_lasso",
    "closed_importance", "closed_elimination", "closed_morphology_gain", "closed_best_imputation", "closed_search_krr",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    from checks import registry
    from skylattice.session import local_session

    spark = local_session(cores, int(cores) if cores.isdigit() else 8)
    queries = registry.queries()
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds_headline_queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
