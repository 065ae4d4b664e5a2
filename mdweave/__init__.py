"""mdweave: a Spark-native engine that builds Markdown documentation corpora
from link-index files and crawl snapshots, for many sources in one job.

Layout
------
functions/  Column -> Column expressions (whitespace, URL resolution, sanitising,
            content sniffing).  All native Catalyst expressions except the NFKD
            fold, which is an Arrow-batched pandas UDF applied only to non-ASCII rows.
sources/    scans and sinks: registry text, link indexes, crawl snapshot,
            manifests, corpus snapshots and review reports.
operators/  the dataflow steps as DataFrame -> DataFrame functions.
plans/      the derived input views over the driver tables and the registered
            queries (plus their DuckDB oracle SQL).
llm/        operators for training-data pipelines (optional; nothing else imports it).
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Pickle this package's functions by value, so that executors run the
    Python steps (html conversion, NFKD fold, greedy numbering) without having
    the package installed or on their path."""
    import sys

    try:
        from pyspark import cloudpickle
    except ImportError:  # pragma: no cover - pyspark always ships it
        return
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()
