"""Registered queries over the supplied tables and the SQL they are compared with."""
