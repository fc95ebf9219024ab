"""Composed flows, and the queries registered for checking."""
