"""Queries over the test tables, each one an operator on a stand-in for meetings, and the SQL that it must equal."""
