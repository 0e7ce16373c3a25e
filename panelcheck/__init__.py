"""Feeds the library with bars derived from the test tables and states each result in plain SQL."""
