"""duolith: Spark-native redescription mining.

Two tables that describe the same entities are mined for pairs of logical
queries, one per table, that hold for nearly the same entities.
"""

__version__ = "0.1.0"
