"""Model-tagged datasets and the operators over them."""
