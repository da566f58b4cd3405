"""Rules over data that keep arriving."""
