"""Headline queries on the bench tables; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from chartspark.plans import registry
from chartspark.session import local_session

HEADLINE = [
    "agg_01_chart_performance", "win_04_stratified_sample", "jon_02_modeling_dataset", "agg_05_describe_by_market", "agg_06_full_profile",
    "agg_10_missingness", "agg_25_pearson_matrix", "dq_04_domain_rules", "dq_06_row_rules", "jon_09_reconcile", "snk_01_upsert",
    "txt_07_word_features", "txt_13_document_language", "mat_19_decision", "mat_11_title_similarity", "sta_01_kruskal_wallis",
    "sta_02_chi_square", "sta_10_cooks_distance", "sta_16_paired_bootstrap", "mlp_06_ols_cluster", "frm_03_recurrence", "frm_08_event_rhythm",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    queries, seconds = registry.queries(), {}
    # one untimed query starts the JVM, the scan code and the Python workers
    queries["frm_03_recurrence"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }), flush=True)


if __name__ == "__main__":
    main()
