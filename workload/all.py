"""Every registered query and its SQL."""

from workload import file_queries, gate_queries, model_queries, text_queries  # noqa: F401
from workload.registry import ORACLES, QUERIES  # noqa: F401
