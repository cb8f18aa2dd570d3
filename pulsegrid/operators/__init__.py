"""Relational, windowed and sequential operators over DataFrames."""
