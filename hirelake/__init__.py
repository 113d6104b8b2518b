"""Hiring intelligence as PySpark DataFrame operators.

Every operator takes DataFrames (plus an explicit ``as_of`` instant instead of
the wall clock) and returns DataFrames; nothing in the package collects rows to
the driver.
"""
