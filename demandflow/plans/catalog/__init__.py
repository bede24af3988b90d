"""Query catalogue, one module per operator family (importing registers)."""

from demandflow.plans.catalog import (  # noqa: F401
    ablation, encoding, ensemble, features, forecast, io, lookup, metrics, models, order, profile, splits, tuning,
)
