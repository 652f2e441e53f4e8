"""trustlens: survey risk analytics on Spark.

Every operator is a function ``DataFrame -> DataFrame`` over a respondent table
(one row per respondent).  Nothing row-level is collected to the driver; the
driver only sees small result tables and model parameters.
"""

__version__ = "0.1.0"
