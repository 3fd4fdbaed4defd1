"""Import every query module so the registry is complete."""

from airwise.plans import catalog_agg, catalog_basic, catalog_env, catalog_functions, catalog_joins, catalog_landed, catalog_ml, catalog_pipelines, catalog_sinks, catalog_streaming  # noqa: F401
from airwise.plans.registry import BENCH, ORACLE, QUERIES, RAW  # noqa: F401
