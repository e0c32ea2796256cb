"""Group-fairness analytics and training-data preparation on Spark DataFrames."""

from evenhand.frame import FairFrame

__all__ = ["FairFrame"]
