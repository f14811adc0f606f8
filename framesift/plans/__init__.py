"""Registered queries over the driver's tables, each with its SQL where SQL can express it."""

from framesift.plans import catalog, editing, edits, labels, names, phases, reduce, similarity, splits, temporal  # noqa: F401
