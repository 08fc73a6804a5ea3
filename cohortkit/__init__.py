"""cohortkit: person-level cohort building, feature screening and evaluation on Spark.

Every public operator is a ``DataFrame -> DataFrame`` function whose work runs on
executors. Python on the driver only ever touches small aggregates (level lists,
bucket boundaries, group totals).
"""

__version__ = "0.1.0"
