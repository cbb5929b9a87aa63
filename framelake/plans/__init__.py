"""Registered queries by subject, each with the SQL that an oracle runs on the same tables."""
