"""Matching and usage accounting on Structured Streaming inputs."""
