"""Readers and writers: raw event files, panels, sequences, reports."""
