"""Roles of the TPC-H-like tables, the registered queries and their SQL."""
