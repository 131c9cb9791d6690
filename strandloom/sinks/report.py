"""The run report: counters, inferred facts and settings as JSON."""

from __future__ import annotations

import datetime
import json
import math


def report(config: dict, counters: dict[str, int], facts: dict) -> str:
    """NaN and infinite numbers are null; an unknown sex is `indeterminate`; liftover counters are part of the counters."""
    clean = lambda v: None if isinstance(v, float) and not math.isfinite(v) else v
    facts = {k: clean(v) for k, v in facts.items()}
    if facts.get("sex") == "unknown":
        facts["sex"] = "indeterminate"
    return json.dumps({"timestamp": datetime.datetime.now(datetime.timezone.utc).isoformat(), "settings": config, "statistics": dict(sorted(counters.items())), **facts}, indent=2)
