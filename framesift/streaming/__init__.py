"""Incremental recomputation of videos as new frames arrive."""
