"""Structured Streaming forms of the operators that are streaming-safe."""
