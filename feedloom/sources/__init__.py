"""Readers and writers of event tables and marts."""
