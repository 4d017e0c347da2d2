"""Registered queries, the tables they run on, and the SQL that checks them."""
