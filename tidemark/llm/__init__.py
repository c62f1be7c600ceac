"""Training-data operators over whole document tables."""
