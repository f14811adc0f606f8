"""Readers: frame folders, embedding files, label files, workbooks, tracker states."""
