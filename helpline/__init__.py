"""helpline: customer-support knowledge base, retrieval and call analytics on Spark.

Everything is expressed as DataFrame / Spark SQL / Structured Streaming plans.
Sub-packages:

* ``sources``   - readers for operational tables, transcripts, documents, index
* ``sinks``     - writers for documents, markdown pages, index versions, calls
* ``functions`` - reusable Column expressions (templates, text, vectors, hashes)
* ``operators`` - knowledge-base export, chunking, search, matching, call analytics
* ``plans``     - composed jobs (index rebuild, call evaluation) and the query catalog
* ``streaming`` - incremental forms of the call jobs
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Python workers on executors need not have this package installed: the
    functions Spark sends them (pandas kernels, UDFs) are pickled by value."""
    import sys

    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # noqa: BLE001 - older pyspark: rely on the package being installed
        pass


_ship_by_value()
