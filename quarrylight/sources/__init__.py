"""Where chunks come from and are kept."""
