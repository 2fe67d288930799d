"""The registry of names, and the routing of statements."""
