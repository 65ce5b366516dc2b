"""Readers: directory trees, contents of files, and tables seen as files."""
