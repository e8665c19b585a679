"""Training-data operators.  Nothing else in larder imports this package."""
