"""Registered queries over the driver's tables, with the SQL that checks them."""
