"""Models, their order, and checks."""
