"""rungkit: Spark-native curriculum text-data engine.

Every operator is a ``DataFrame -> DataFrame`` function with explicit
ordering keys and hash-derived randomness, so results do not depend on
partitioning, task order or retries.
"""

__version__ = "0.1.0"
