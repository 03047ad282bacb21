"""Readers and writers of logs and dimensions."""
