"""netsleuth: behavioural analytics on network-sensor events, expressed as
Spark DataFrame operators.

Layout
------
functions/  Column -> Column expressions (IP arithmetic, time, hashing, rule text)
sources/    readers: JSON-lines events, mode log, rule files, stored artefacts
operators/  DataFrame -> DataFrame operators: ingest, features, scaling,
            isolation forest, thresholds, evaluation, rules, exploration
plans/      registered query builders and their DuckDB oracle SQL
streaming/  Structured Streaming jobs reusing the batch transforms
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Functions this package hands to Python workers (tree building, scoring,
    stateful streaming) are pickled by value, so executors need no copy of
    the package on their path."""
    try:
        import sys

        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # noqa: BLE001  (older cloudpickle: fall back to by-reference pickling)
        pass


_ship_by_value()
