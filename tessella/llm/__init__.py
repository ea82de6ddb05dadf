"""Operators of a training-data pipeline. Nothing outside this package imports it.

Each module holds one operator with its own general interface; ``queries`` binds
them to the tables of the driver, ``oracles`` holds the SQL to compare with.
"""
