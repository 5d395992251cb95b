"""sevlake: a Spark-native engine for threat-indicator (IOC) tables.

Every operator is a ``DataFrame -> DataFrame`` function built on the public
PySpark DataFrame / SQL / ML API, composable with ``DataFrame.transform``.
"""

__version__ = "0.1.0"
