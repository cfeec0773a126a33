"""loomspan: population-genomics analytics and record preparation on PySpark."""

__version__ = "0.1.0"
