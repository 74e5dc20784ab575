"""Text and XML of small, collected results."""
