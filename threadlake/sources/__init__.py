"""Readers and writers: bronze, gold, points, golden set, feedback."""
