"""Query plans over the tables, and their registry."""
