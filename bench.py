"""Times the headline queries at one scale and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tallymark.plans import load_catalog  # noqa: E402
from tallymark.session import build_session  # noqa: E402

HEADLINE = (
    "threshold_sweep",
    "sweep_by_domain",
    "sweep_grid_ties",
    "maximin_threshold",
    "rank_auc",
    "roc_gate",
    "epoch_metrics",
    "variant_table",
    "field_cer",
    "page_window_cer",
    "cer_breakdown",
    "running_cer",
    "stratified_sample",
    "holdout_split",
    "seeded_order",
    "dual_domain_manifest",
    "diff_pairs",
    "pair_similarity",
    "scored_pair_sweep",
    "leak_exact",
    "leak_exact_rows",
    "leak_near",
    "near_rows",
    "dataset_fingerprint",
    "identity_score",
    "extract_handles",
    "idnumber_checksum_scan",
    "annotation_fields",
    "ocr_blocks",
    "latency_by_type",
    "score_histogram",
    "gate_summary",
    "batch_score",
    "stream_threshold_counts",
    "stream_lookup_cache",
    "evaluate_documents",
    "train_minus_eval",
    "legacy_sample",
    "leak_near_crowded",
    "leak_verdict",
    "manifest_bad_lines",
    "annotation_read",
    "file_digests",
    "latency_percentiles",
    "evaluate_forgery_domains",
    "evaluate_documents_breakdown",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog = load_catalog()
    catalog["class_balance"].run(spark, folder).write.format("noop").mode("overwrite").save()
    spent: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        started = time.perf_counter()
        catalog[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - started, 3)
    scale = Path(folder).name.removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(spent.values()), 3),
                "unit": "sec",
                "queries": spent,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )


if __name__ == "__main__":
    main()
