"""Operators over DataFrames of assets, relationships and events."""
