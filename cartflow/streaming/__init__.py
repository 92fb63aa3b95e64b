"""Structured Streaming over event folders: windows, sessions, and a writer that replays leave unchanged."""
