"""All registered queries: importing the query modules fills the registry."""

from __future__ import annotations

import importlib
import importlib.util

from listloom.plans.registry import ORACLES, RUNNERS

MODULES = ("functions_q", "sources_q", "sinks_q", "filters_q", "joins_q", "dedup_q", "upsert_q", "rollup_q", "streaming_q")


def load() -> tuple[dict, dict]:
    for m in MODULES:
        importlib.import_module(f"listloom.plans.{m}")
    return RUNNERS, ORACLES
