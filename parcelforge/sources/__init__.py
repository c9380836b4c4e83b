"""Sources of the parcel feature engine."""
