"""All registered queries of this subpackage."""

from panelspark.llm import queries  # noqa: F401  (importing registers the queries)
from panelspark.llm.registry import ORACLES, QUERIES  # noqa: F401
