"""Readers and writers for feature files, results and class files."""
