"""From requests to DataFrame plans."""
