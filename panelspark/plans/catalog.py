"""All registered queries."""

from panelspark.plans import (  # noqa: F401  (importing registers the queries)
    queries_attribution,
    queries_checks,
    queries_models,
    queries_relational,
    queries_sources,
)
from panelspark.plans.registry import ORACLES, QUERIES  # noqa: F401
