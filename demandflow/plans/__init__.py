"""Named query catalogue: Spark plans (``queries``) and DuckDB oracle SQL (``oracle_sql``)."""

from demandflow.plans.registry import ORACLE, QUERIES  # noqa: F401
from demandflow.plans import catalog  # noqa: F401,E402  (registers the queries)
