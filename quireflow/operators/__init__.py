"""DataFrame operators grouped by the stage of work they serve."""
