"""Ledgerline: a PySpark-native commerce analytics engine.

Every operator is a DataFrame -> DataFrame function; only ``sources`` and the
stage runners in ``plans`` do input and output.
"""
