"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run once to warm the JVM and twice for the clock, of which the
faster counts, into a sink that computes every column and keeps none.  The last entry is the seasonal
amplitude in single-process numpy over the same rows, for comparison.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from eoframe.plans.catalogue import RUNS  # noqa: E402
from eoframe.session import SETTINGS  # noqa: E402

HEADLINE = (
    "seasonal_amplitude_ndvi",
    "index_distribution",
    "track_inventory",
    "aoi_cloud",
    "top_per_period",
    "dnbr_classes",
    "sar_amplitude",
    "observation_summary",
    "resample_bilinear",
    "drop_same_photo",
    "kml_audit",
)


def numpy_amplitude(sf_dir: str) -> float:
    """Seconds for the NDVI amplitude with pandas and numpy in one process."""
    import numpy as np
    import pandas as pd

    t0 = time.time()
    li = pd.read_parquet(
        f"{sf_dir}/lineitem.parquet",
        columns=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"],
    )
    red = 1000 + li.l_quantity.astype("int64") * 40
    nir = 1500 + (li.l_extendedprice * 100).round().astype("int64") % 4000
    ls = li.l_suppkey % 3 == 0
    shift = np.where(li.l_suppkey % 2 == 0, -1000.0, 0.0)
    red = np.where(ls, red * 0.0000275 - 0.2, (red + shift) / 10000)
    nir = np.where(ls, nir * 0.0000275 - 0.2, (nir + shift) / 10000)
    with np.errstate(divide="ignore", invalid="ignore"):
        v = (nir - red) / (nir + red)
    scl = (li.l_orderkey * 7 + li.l_linenumber) % 12
    qa = (li.l_orderkey * 5 + li.l_suppkey) % 64
    bad = np.where(ls, (qa & 31) != 0, np.isin(scl, (0, 1, 3, 8, 9, 10)))
    v = np.where(bad | ~((v >= -1) & (v <= 1)), np.nan, v)
    dry = li.l_shipdate.dt.month.isin((12, 1, 2, 3, 4)).to_numpy()
    sides = []
    for side in (dry, ~dry):
        g = pd.Series(v[side]).groupby(li.l_partkey.to_numpy()[side])
        sides.append(pd.DataFrame({"n": g.count(), "m": g.median()}))
    both = sides[0].join(sides[1], how="outer", lsuffix="_d", rsuffix="_w")
    np.where((both.n_d >= 3) & (both.n_w >= 3), both.m_d - both.m_w, np.nan)
    return time.time() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in SETTINGS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        runs = []
        for _ in range(3):
            t0 = time.time()
            RUNS[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - t0)
        seconds[name] = round(min(runs[1:]), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    seconds["numpy_amplitude_comparison"] = round(numpy_amplitude(sf_dir), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
