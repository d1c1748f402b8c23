"""glimmer: a Spark-native radar for technologies that are still small.

Every public operator is a function from DataFrames to a DataFrame; the plan stays declarative so
that Catalyst picks the physical strategy.
"""
