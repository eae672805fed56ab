"""Analytic operators: every one takes and returns DataFrames and leaves the plan to Catalyst."""
