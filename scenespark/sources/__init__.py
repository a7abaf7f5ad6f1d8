"""Readers and writers: raw scenes, question files, logs, aggregate tables."""
