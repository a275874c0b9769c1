"""Named queries, reports and model workflows."""
