"""Project-margin analytics for a contractor's portfolio, as Spark DataFrame operators.

Every operator takes a mapping of table name to DataFrame and returns a lazy
DataFrame.  See README.md for the inventory.
"""
