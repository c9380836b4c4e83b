"""Plans of the parcel feature engine."""
