"""Headline queries timed on local[BENCH_CPUS] over BENCH_SF_DIR. Prints one JSON line.

With BENCH_DUCKDB=1 the line also holds DuckDB's time for each oracle on the same machine and tables.
"""

from __future__ import annotations

import json
import os
import time

HEADLINE = [
    "a2_radius_rollup_by_facility", "a1_facility_years", "a3_reconcile_totals", "a5_dedupe_and_bucket",
    "a4_merge_certifications", "j6_semi_join_of_wanted_ids", "j1_dimension_breakdown", "j9_radius_join",
    "j10_nearest_within_cap", "j12_point_in_polygon", "j17_interval_overlap", "j18_certificate_as_of", "j19_explained_by_event",
    "w1_latest_per_key", "w5_top_items_of_latest_year", "w6_on_off_transitions", "w7_merge_intervals",
    "w13_sibling_median_outliers", "a12_percentiles_per_bin", "a21_exposure_integral", "g1_connected_components",
    "g4_bearing_posterior", "t1_number_facts", "t12_near_variant_tally", "t2_table_rows_from_cells", "o6_changed_lines",
    "s3_grid_microdata_two_layouts", "x2_tumbling_hours",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from fieldbook.catalog import load_all
    from fieldbook.session import local_session

    queries, oracles = load_all()
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "fieldbook-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries["w1_latest_per_key"](spark, sf).limit(1).collect()  # start the engine before timing
    names = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n] or HEADLINE
    times, duck_times = {}, {}
    for name in names:
        t = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    if os.environ.get("BENCH_DUCKDB"):
        import duckdb
        con = duckdb.connect()
        con.execute(f"set threads={cpus if cpus.isdigit() else 8}")
        for t in ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
                  "labels conversations").split():
            con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
        for name in names:
            if name in oracles:
                t = time.time()
                con.execute(oracles[name]).fetchall()
                duck_times[name] = round(time.time() - t, 3)
    out = {"metric": "headline query seconds, total", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}
    if duck_times:
        out["duckdb"] = duck_times
    print(json.dumps(out))


if __name__ == "__main__":
    main()
