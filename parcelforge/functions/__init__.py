"""Functions of the parcel feature engine."""
