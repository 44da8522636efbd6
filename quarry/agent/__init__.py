"""Tools over an index, and a loop that answers questions with them."""
