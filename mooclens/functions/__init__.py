"""Column-level helpers (all built-in Spark expressions, no Python UDFs)."""

from mooclens.functions.scalar import *  # noqa: F401,F403
