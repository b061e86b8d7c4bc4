"""Whole queries over the tables of a folder, and the SQL they are checked against."""
