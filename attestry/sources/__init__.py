"""Where data comes from, and which row is which."""
