"""Time series of gridded satellite and terrain data as Spark DataFrames.

Every public function takes and returns DataFrames (or Columns) and stays
lazy: nothing is collected, so a whole analysis is planned as one query.
"""

__version__ = "0.1.0"
