"""Telemetry evidence on Spark: why did a tracker go silent?

Every operator takes DataFrames and returns DataFrames.  Times are ``TimestampType`` columns
under a UTC session; arithmetic is in whole milliseconds.
"""

__version__ = "0.1.0"
