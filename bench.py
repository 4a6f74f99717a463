"""Times headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR and prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

HEADLINE = (
    "q8_query_spec", "a4_median", "w1_ranking", "w1_row_number_split", "t2_duplicate_rows", "t4_value_range", "t9_trend", "t15_cohort_retention", "t16_zscore_outliers",
    "c1_keep_first", "c8_impute_mode", "c10_ffill", "c12_interpolate", "c18_winsorize", "c31_label_encode", "c35_target_encode_loo", "c43_ts_features", "c44_standard",
    "c47_quantile_normal", "c28_text_features", "c30_tfidf_weights", "c60_apply_recipe", "d2_duplicate_columns", "d9_iqr", "d19_detect_types", "d37_text_consistency",
    "f0_profile", "f4_column_profile", "f5_numeric_profile", "f12_datetime_profile", "f14_mutual_information_all", "f16_pii_scan", "f19_correlations", "f20_cramers_v",
    "h3_mann_whitney", "h5_anova", "h9_levene", "i1_quality_score", "i8_psi", "i9_ks_2samp", "s1_delimited", "s3_infer_types", "j10_suggest_by_values",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1].split(",") if len(sys.argv) > 1 else list(HEADLINE)

    from lodeframe.session import session

    spark = session(f"local[{cpus}]", shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    from lodeframe.catalog import catalog

    queries = catalog().queries
    if names == ["all"]:
        names = list(queries)
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    times, failed = {}, {}
    for name in names:
        start = time.time()
        try:
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - start, 3)
        except Exception as e:
            failed[name] = str(e).splitlines()[0][:200]
    found = re.search(r"sf([0-9.]+)", folder)
    result = {"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(found.group(1)) if found else folder}
    if failed:
        result["failed"] = failed
    print(json.dumps(result))


if __name__ == "__main__":
    main()
