"""Times headline queries: one JSON line with seconds per query (BENCH_SF_DIR, BENCH_CPUS). --all: every core query, with DuckDB's seconds for its SQL."""

import json
import os
import sys
import time
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

from pyspark.sql import SparkSession  # noqa: E402

from tesselon.plans import catalog  # noqa: E402

HEADLINE = [
    "class_histogram", "histogram_zero_filled", "health_audit", "health_audit_by_split", "suspicious_images", "pixel_boxes", "image_boxes", "tile_remap", "named_histogram", "nms",
    "pairs_left", "pairs_positional", "stratified_split", "rename_plan", "mosaic_plan", "letterbox_plan_fit", "strip_segments", "dictionary_clean", "parse_totals", "image_detections",
    "score_distribution", "confusion_normalised", "confidence_tiers", "label_texts", "kernel_erosion", "augmented",
]


def duck(sf: str) -> dict[str, float]:
    """Median seconds of three runs of each query's SQL."""
    import duckdb

    con = duckdb.connect()
    for t in Path(sf).glob("*.parquet"):
        con.sql(f"create view {t.stem} as select * from '{t}'")
    out = {}
    for name, sql in sorted(catalog.ORACLE_SQL.items()):
        times = []
        for _ in range(3):
            began = time.time()
            con.execute(sql).to_arrow_table()
            times.append(time.time() - began)
        out[name] = round(sorted(times)[1], 3)
    return out


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in sorted(catalog.QUERIES) if "--all" in sys.argv else HEADLINE:
        times = []
        for _ in range(3):
            began = time.time()
            catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        took[name] = round(sorted(times)[1], 3)
    out = {"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(sf).name.removeprefix("sf")}
    print(json.dumps(out | ({"duckdb": duck(sf)} if "--all" in sys.argv else {})))


if __name__ == "__main__":
    main()
