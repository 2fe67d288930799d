"""Where tables are kept, read from and written to."""
