"""Part of tarnloom."""
