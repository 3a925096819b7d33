"""DataFrame-to-DataFrame operators. None of them reads a path, a clock or a session setting."""
