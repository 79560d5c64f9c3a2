"""Operators for preparing training data: one module each, with queries and the pipeline's stages beside them."""
