"""Finite models, signed bags and positive first-order axioms as Spark DataFrames."""
