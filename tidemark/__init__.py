"""Point-in-time analytics over columnar tables, planned by Catalyst."""
