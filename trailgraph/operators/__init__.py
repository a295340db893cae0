"""Graph operators as DataFrame plans."""
