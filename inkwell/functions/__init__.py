"""Column functions: expressions that Catalyst sees through, no Python at run time."""
