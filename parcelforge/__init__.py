"""Parcel feature engine: spatial, attribute and time-series feature tables as Spark DataFrame plans."""
