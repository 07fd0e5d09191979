"""Column functions that users of the engine combine: vectors, hashes, severities and group keys."""

from quarrykit.operators.dedupe import group_key, hamming
from quarrykit.operators.vector import l1
from quarrykit.plans.domain import dot, severity_rank

__all__ = ["dot", "group_key", "hamming", "l1", "severity_rank"]
