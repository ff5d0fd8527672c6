"""Reading plans, and the catalogue of queries."""
