"""Entity-form analytics on Spark DataFrames.

Everything takes and returns DataFrames (or Columns); the names of the entity,
time, tiebreak and measure columns are always parameters.
"""
