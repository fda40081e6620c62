"""Operators over DataFrames of samples, windows, trials, predictions."""
