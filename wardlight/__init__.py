"""Security-telemetry analytics written as Spark DataFrame jobs.

Every public function takes and returns DataFrames (or Columns).  Nothing in
the library reads the wall clock: a job that depends on "now" takes ``as_of``.
"""

__version__ = "0.1.0"
