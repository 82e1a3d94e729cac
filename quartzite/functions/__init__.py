"""Part of the quartzite panel engine."""
