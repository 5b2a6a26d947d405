"""Radar inventory, order plan and collection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eoframe import dims
from eoframe.operators import radar


def sar_inventory(granules: DataFrame, res_m: int = 10, orbit: str = "any", track: int = 0) -> dict[str, DataFrame]:
    """Tracks of normalised granules, ranked; track 0 means all."""
    kept = radar.filter_orbit(granules, orbit)
    if track:
        kept = kept.where(F.col("relative_orbit") == track)
    inventory = radar.track_inventory(kept, res_m)
    apt = inventory.where((F.col("n_dry") > 0) & (F.col("n_wet") > 0))
    return {"inventory": inventory, "ranking": radar.rank_tracks(apt), "missing_keys": radar.missing_keys(kept)}


def sar_order_plan(
    granules: DataFrame,
    track: int,
    res_m: int = 10,
    wanted: Sequence[str] = ("VH",),
    dry: Sequence[int] = dims.DRY_MONTHS,
    wet: Sequence[int] = dims.WET_MONTHS,
    cap: int = 3000,
    balance: float | None = None,
    min_obs: int = dims.MIN_OBS,
) -> dict[str, DataFrame]:
    """What would be ordered for a track, in requests of at most 200, and whether it may be.

    Nothing is sent.
    """
    if res_m not in dims.CREDITS:
        raise ValueError(f"pixel spacing is one of {sorted(dims.CREDITS)}")
    if not dry or not wet or set(dry) & set(wet):
        raise ValueError("both seasons need months and none may be in both")
    mine = granules.where(F.col("relative_orbit") == track)
    verdicts = radar.classify_granules(mine, dry, wet, wanted)
    useful = verdicts.where("is_useful")
    counts = radar.season_split(useful, [], dry, wet)
    cost = counts.withColumns(
        {
            "cost": F.col("n") * dims.CREDITS[res_m],
            "cap": F.lit(cap),
            "balance": F.lit(balance).cast("double"),
        }
    )
    return {
        "granules": verdicts,
        "feasibility": radar.order_feasibility(mine, wanted, min_obs, dry, wet),
        "verdict": radar.validate_order(cost),
        "options": radar.affordable_options(cost.select("n", "balance")),
        "requests": radar.batch_requests(useful, [F.col("order_name"), F.col("granule")]),
    }


def sar_collect(
    power: DataFrame,
    pols: Sequence[str] = ("VH", "VV"),
    pixel: Sequence[str] = ("grid", "px_col", "px_row"),
    dry: Sequence[int] = dims.DRY_MONTHS,
    wet: Sequence[int] = dims.WET_MONTHS,
    min_obs: int = dims.MIN_OBS,
) -> DataFrame:
    """Seasonal amplitude per polarisation, track and pixel, with RVI when both are there.

    ``power`` has vh and vv columns of one time stamp per row.
    """
    if not 1 <= min_obs <= 60:
        raise ValueError("min_obs must lie in 1..60")
    keys = ("pol", "track", *pixel)
    out = radar.sar_amplitude(radar.sar_power(power, pols), keys, dry=dry, wet=wet, min_obs=min_obs)
    if {"VH", "VV"} <= set(pols):
        out = out.unionByName(radar.rvi_amplitude(power, keys, dry=dry, wet=wet, min_obs=min_obs))
    return out
