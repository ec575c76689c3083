"""Event forecasting on time-stamped sensor data, as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

from vaneworks.schema import FEATURES, LABEL, PipelineConfig

# functions that run in tasks travel with their code, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["FEATURES", "LABEL", "PipelineConfig"]
