"""Time the headline jobs; prints one JSON line.

Each job runs once to warm up and then up to three times; the median counts. Every
result row is materialised by a no-op write, so nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from ledgerloom.plans import load_queries
from ledgerloom.session import build_session

HEADLINE = [
    "ae_study_by_sex_smoker", "claim_experience_by_segment", "lapse_rate_by_policy_year", "portfolio_metrics", "portfolio_summary_by_submission",
    "cedent_experience_bands", "treaty_rates", "deal_pricing", "ceded_claims_by_treaty", "gaap_reserves", "economic_reserves", "commercial_premiums",
    "risk_based_capital", "missing_values", "numeric_column_profile", "rule_report", "policy_upload_scores", "smart_imputation", "capped_outliers",
    "parsed_messy_dates", "integrated_treaties", "dataset_relationships", "detected_file_types", "financial_features", "actuarial_features",
    "rate_features", "embedding_outliers", "header_candidates", "sheet_junk_rows", "score_auc",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench", master=f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g",
           "spark.checkpoint.dir": os.environ.get("BENCH_SHARED_DIR") or f"file://{tempfile.mkdtemp(prefix='bench-')}"},
    )
    jobs = load_queries()
    times: dict[str, float] = {}
    for name in HEADLINE:
        got = []
        for i in range(runs + 1):
            t0 = time.perf_counter()
            jobs[name](spark, folder).write.format("noop").mode("overwrite").save()
            if i:
                got.append(time.perf_counter() - t0)
            if sum(got) > 10:  # a long job is not repeated further
                break
        times[name] = round(statistics.median(got), 4)
    lines = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("sum(size(split(text, '\n'))) AS n").first().n
    f1 = jobs["labelled_junk_quality"](spark, folder).where("layer = 'statistical'").first()["f1"]
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(folder).name.removeprefix("sf"),
        "junk_rows_per_second": round(lines / times["sheet_junk_rows"]), "junk_f1": round(f1, 4), "shuffle_partitions": int(cpus), "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
