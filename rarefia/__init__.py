"""Rarefied allelic diversity on Spark DataFrames."""
