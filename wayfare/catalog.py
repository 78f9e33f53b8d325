"""All registered queries over the driver's tables, and their DuckDB SQL."""

from wayfare.plans import messages, profiles, traces, trajectories
from wayfare.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "messages", "profiles", "traces", "trajectories"]
