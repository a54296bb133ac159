"""Readers: the tables that the operators start from."""
