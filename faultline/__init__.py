"""Spark-native analytics over CI/CD pipeline history.

Every operator is a plain function ``op(df, ..., **params) -> DataFrame``: it
declares a plan and leaves execution to Catalyst and AQE.  Nothing here
triggers an action unless its docstring says so.
"""
