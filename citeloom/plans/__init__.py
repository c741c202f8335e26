"""Whole jobs, the command line, and the registered queries."""
