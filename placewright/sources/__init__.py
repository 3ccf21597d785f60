"""Readers and writers, table contracts and header discovery."""
