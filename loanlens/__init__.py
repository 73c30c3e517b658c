"""loanlens: loan-default analytics as Spark jobs.

Profile, clean, validate, derive and encode loan applications, fit and
evaluate imbalanced binary classifiers, score in batch and as a stream, and
compare two populations for drift. Every operator takes and returns a
DataFrame; only k-row summaries (names, fitted constants, curves) reach the
driver.
"""

from loanlens.session import get_spark

__all__ = ["get_spark"]
