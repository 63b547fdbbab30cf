"""evlens: product analytics over an event log, as lazy Spark DataFrames.

Every public operator takes DataFrames in the canonical event shape (see
``evlens.schema``) plus plain Python parameters, and returns a lazy DataFrame.
Nothing in the library collects data to the driver.
"""

__all__ = ["schema", "session"]
