"""Query front end and planner."""
