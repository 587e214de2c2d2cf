"""Typed panel operators: DataFrame to DataFrame, keys and windows as parameters."""
