"""Metric operators: functions from DataFrames to DataFrames. None collects."""
