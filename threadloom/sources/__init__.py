"""Readers for batch and stream inputs."""
