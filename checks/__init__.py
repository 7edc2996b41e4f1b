"""Registered queries next to the SQL that must give the same rows."""
