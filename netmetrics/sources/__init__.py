"""Where graphs come from."""
