"""loomcast: panel (many-series) forecasting analytics as Spark DataFrame jobs.

Every public function takes and returns DataFrames.  Folds, models and
horizons are columns, so one Spark job covers every fold of every series.
"""

from loomcast.config import CvConfig

__all__ = ["CvConfig"]
