"""oddsmill: scorecard analytics as Spark plans.

``operators`` build DataFrames, ``functions`` build Columns, ``plans`` hold the
declarative feature recipes and the registered queries, ``sources`` read and
write, ``streaming`` runs monitors on micro-batches.
"""

__version__ = "0.2.0"
