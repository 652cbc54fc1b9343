"""Palimpsest: change history of folders from piles of snapshots, on Spark DataFrames."""
