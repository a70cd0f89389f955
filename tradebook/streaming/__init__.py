"""Structured Streaming jobs; each runs until the available input is done, or for ever."""
