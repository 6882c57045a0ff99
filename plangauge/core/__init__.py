"""Constants, session helpers and shared staging used by every other module."""
