"""corpusflow: Spark-native curation of code/text corpora and retrieval analytics.

Every operator is a function ``DataFrame -> DataFrame`` built from Spark SQL
built-ins so Catalyst can push filters, prune columns and plan the shuffles.
"""

from corpusflow.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
