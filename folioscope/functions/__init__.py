"""Scalar functions over text, identifiers, citations and names."""
