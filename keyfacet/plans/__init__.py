"""Models behind the engine and the engine itself."""
