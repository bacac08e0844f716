"""Column functions for terms and times."""
