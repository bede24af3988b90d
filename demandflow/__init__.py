"""demandflow: location-and-time demand analytics as Spark DataFrame operators.

Every public operator takes DataFrames and returns DataFrames.  Fitted
operators are split into ``fit_*`` (an aggregate over an explicit fitting
period) and ``apply_*`` (a join of the fitted table back onto the rows), so
leakage control is a visible argument instead of a convention.

Sub-packages:

* ``sources``   -- the observation view over the driver tables, CSV/parquet IO,
                   prediction alignment, output contract checks.
* ``functions`` -- scalar Column builders (time, geohash, categorical, numeric).
* ``operators`` -- profiling, encoders, lookups, ordering, splits, metrics,
                   ensembles, forecasting, model fitting, importance.
* ``plans``     -- the named query catalogue (Spark side and DuckDB oracle SQL).
* ``streaming`` -- intentionally empty: the reference has no streaming layer.
"""

__version__ = "0.1.0"
