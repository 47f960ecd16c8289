"""Column and session helpers shared by the planner and the operators."""
