"""Parcel-delivery event analytics on Spark DataFrames."""
