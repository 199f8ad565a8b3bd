"""Import every query module so that the registry is complete."""

from . import q_attain, q_clean, q_disclose, q_link, q_sources, q_stats, q_tables, q_trend, q_uptake  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
