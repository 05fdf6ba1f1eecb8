"""recoflow: implicit-feedback recommendation on Spark DataFrames.

Every public function takes and returns DataFrames; only metric scalars or
bounded control values (row counts, partition counts) ever reach the driver.
"""

__version__ = "0.1.0"
