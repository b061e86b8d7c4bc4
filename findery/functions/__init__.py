"""Column functions: the analyzer, ranking formulas, vectors, hashing, embedding."""

from pyspark.sql import SparkSession


def register_sql_functions(spark: SparkSession) -> None:
    """``analyze``, ``shard_for``, ``idf`` and ``rrf_term`` for SQL."""
    from findery.functions.analysis import register_analysis
    from findery.functions.formulas import register_formulas
    from findery.functions.hashing import register_hashing

    register_analysis(spark)
    register_hashing(spark)
    register_formulas(spark)
