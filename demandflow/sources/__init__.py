"""Sources and sinks: the observation view over the driver tables and file IO."""

from demandflow.sources.observations import (  # noqa: F401
    OBS_COLUMNS, base_predictions, lookup_samples, observations, reference_period,
    split_periods, table, target_period,
)
