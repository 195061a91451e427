"""loomline: daily panel analytics on Spark DataFrames.

Daily attention series and asset returns go in as long tables; shocks, kernel
covariances, factor models, tests and scorecards come out as long tables.
"""

__version__ = "0.1.0"
