"""Antimicrobial-susceptibility analytics on Spark DataFrames."""
