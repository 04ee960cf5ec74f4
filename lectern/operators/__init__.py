"""DataFrame operators: rows in, rows out, planned by Catalyst."""
