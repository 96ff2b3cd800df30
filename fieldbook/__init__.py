"""fieldbook: DataFrame and Structured Streaming operators for messy public records.

Sub-packages
------------
functions   Column factories (no shuffles, JVM side wherever Spark has the function)
operators   DataFrame -> DataFrame jobs (joins, aggregation, ranking, documents, statistics)
plans       plan shapes shared by the operators (ordered chunks, skew, quantiles, durable cuts)
sources     readers and writers
streaming   Structured Streaming forms
catalog     one registered query per operator, with its DuckDB oracle
"""

__version__ = "0.1.0"
