"""Column helpers and the fixed values the jobs share."""
