"""End-to-end plans that compose operators."""
