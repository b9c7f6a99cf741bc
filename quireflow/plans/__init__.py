"""Jobs that chain several operators into one stage of production."""
