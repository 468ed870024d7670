"""labelflow: labelled-text classification analytics on Spark DataFrames.

Every operator is a function ``DataFrame -> DataFrame`` (usable with
``df.transform``) built from Spark SQL expressions, so Catalyst plans it and
the work is partitioned across the cluster.
"""

__version__ = "0.1.0"
