"""Graph operators: lazy DataFrame plans, except closures, which run a loop of jobs."""
