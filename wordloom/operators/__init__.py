"""Operators: functions from model tables to DataFrames."""
