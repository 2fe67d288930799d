"""Live reading of topics."""
