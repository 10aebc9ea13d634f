"""Model-evaluation analytics as Spark jobs.

Every public function takes and returns DataFrames or Columns; nothing here
pulls table data to the driver.
"""
