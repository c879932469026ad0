"""Functions over vector tables and the state around them."""
