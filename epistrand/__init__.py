"""Event-history analytics on Spark.

Raw coded records become censored, visit-structured token sequences, labelled
cohorts, fixed-length training tables and evaluation reports. Everything is a
``DataFrame -> DataFrame`` function.
"""
