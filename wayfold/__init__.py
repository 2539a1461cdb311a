"""wayfold: evidence and outreach analytics as Spark DataFrame jobs.

Every public function takes DataFrames (and, where time matters, an explicit
``as_of``) and returns a DataFrame.  Nothing here triggers a job except the
helpers in :mod:`wayfold.session` that cut lineage or write tables.
"""

__version__ = "0.1.0"
