"""All registered queries: importing this module fills the registry."""

from __future__ import annotations

from eoframe.plans import catalog_queries, grid_queries, mosaic_queries, optical_queries, radar_queries, run_queries, text_queries  # noqa: F401
from eoframe.plans.registry import RUNS, SQL  # noqa: F401
