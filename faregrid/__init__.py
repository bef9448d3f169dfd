"""Zone revenue analytics on Spark: functions from DataFrames to DataFrames."""

from faregrid.params import DEFAULTS, Params

__all__ = ["DEFAULTS", "Params"]
