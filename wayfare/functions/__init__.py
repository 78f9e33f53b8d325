"""Part of the mobility-contact engine; see README.md."""
