"""Checks, authority, propagation, audit and summaries over the registry."""
