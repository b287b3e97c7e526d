"""vulnlake: a vulnerability-dataset pipeline and its analyses as Spark DataFrame operators.

* ``vulnlake.functions``  Column functions (URLs, CVE record, features, text)
* ``vulnlake.operators``  DataFrame -> DataFrame operators (filters, joins, as-of joins,
  aggregations, windows, patch / reply / snippet text, intent, planned analyses)
* ``vulnlake.sources``    readers and writers
* ``vulnlake.streaming``  incremental loads with Structured Streaming
* ``vulnlake.plans``      derived views, the registered queries and their oracles, end-to-end flows
"""

__version__ = "0.1.0"
