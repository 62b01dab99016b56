"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line {"metric", "value", "unit", "queries", "sf"}.

Each query is built (including its small eager jobs: min/max, bucket
boundaries, category lists) and fully executed into the no-op sink, so the
time covers the whole plan and no result is pulled to the driver.  The four
classifiers are also timed apart, fit and score, on prepared rows written
beforehand (median of three).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flagship", "txn_view", "get_dummies", "drop_duplicates", "duplicate_count", "value_counts",
    "histograms_multi", "box_stats", "kde_amount", "all_target_correlations", "correlation_matrix_spearman",
    "auc_roc", "roc_curve", "classification_metrics", "compare_models", "split_stratified",
    "oversample_replicate", "knn_within", "smote", "naive_bayes_scores", "random_forest_score",
    "logistic_score", "decision_tree_score", "profile_numeric_lineitem", "profile_quantiles",
    "profile_top_values", "profile_categorical", "profile_alerts", "knn_embeddings", "smote_embeddings",
    "balance_two_rounds", "tune_nb", "sweep_smoothing", "run_all",
]


def fit_and_score(spark, sf_dir: str) -> dict[str, float]:
    """Median seconds of three fits and three scorings of each classifier."""
    from ledgerlens import schema as S
    from ledgerlens.plans import models
    from ledgerlens.plans.flow import prepared_features
    from ledgerlens.session import cut_lineage
    rows = cut_lineage(prepared_features(spark, sf_dir), "bench-prepared")
    out = {}
    for kind in models.KINDS:
        fits, scores = [], []
        for _ in range(3):
            t0 = time.perf_counter()
            model = models.train_model(kind, rows, S.FEATURES, S.LABEL, seed=7)
            t1 = time.perf_counter()
            models.score(model, rows, S.LABEL).write.format("noop").mode("overwrite").save()
            fits.append(t1 - t0)
            scores.append(time.perf_counter() - t1)
        out[f"{kind}_fit_only"] = round(statistics.median(fits), 3)
        out[f"{kind}_score_only"] = round(statistics.median(scores), 3)
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    from ledgerlens.plans import catalog
    from ledgerlens.plans.flow import flagship
    from ledgerlens.session import local_session

    spark = local_session(cpus, max(8, int(cpus)), app="ledgerlens-bench")
    queries = dict(catalog.QUERIES)
    queries["flagship"] = flagship
    names = only or HEADLINE
    # warm-up: JVM, codegen caches, parquet footers
    flagship(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        df = queries[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    if not only:
        times.update(fit_and_score(spark, sf_dir))
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else sf_dir
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
