"""Registered queries over the star-schema tables, and the SQL each is checked against."""
