"""Weighbridge: rule-scored labelled data as Spark DataFrames."""
