"""Operators of the parcel feature engine."""
