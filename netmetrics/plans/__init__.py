"""Registered queries and the SQL that they are held against."""
