"""Registered queries and the facade."""
