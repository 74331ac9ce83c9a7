"""postlens: PySpark-native analytics for large collections of short public posts.

Every operator is a function from DataFrame to DataFrame expressed with Spark SQL
expressions, ``pyspark.ml`` or Structured Streaming.  Sub-packages:

* ``sources``   – readers, writers and sinks (JSON dumps, splits, crawled HTML, insert-if-new)
* ``functions`` – column-level text, number, date and vector functions
* ``operators`` – table-level operators (time series, keywords, sampling, labels, metrics, ...)
* ``plans``     – the query catalogue run by the driver, with DuckDB oracle SQL
* ``streaming`` – Structured Streaming twins of the batch operators
"""

from postlens.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
