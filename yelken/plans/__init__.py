"""Registered queries over the tables, by area, with the SQL that checks them."""
