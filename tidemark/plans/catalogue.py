"""All named queries of the library; importing the modules registers them."""

from . import q_aggregates, q_composites, q_files, q_joins, q_quant, q_scalar, q_sources, q_streaming, q_windows  # noqa: F401
from .registry import oracle_sql, queries  # noqa: F401
