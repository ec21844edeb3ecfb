"""Operators from DataFrame to DataFrame: search, lifecycle, graph, reports."""
