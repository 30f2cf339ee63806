"""The online form of the relative filter."""
