"""Training-data operators. Self-contained: the rest of the library never imports this folder."""
