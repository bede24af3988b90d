"""Streaming: intentionally empty.

The reference loads complete files and has no stream sources, watermarks,
windows over event time or stateful operators ("real-time" there means the
batch early-slot trend, ``operators.forecast.trend``).  Nothing is built here
so that no operator exists without a counterpart in the reference.
"""
