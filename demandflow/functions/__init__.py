"""Scalar ``Column`` builders.  Everything here stays JVM-side (no UDFs) so
it fuses into whole-stage codegen with the scan that feeds it."""

from demandflow.functions import categorical, geo, numeric, time  # noqa: F401
