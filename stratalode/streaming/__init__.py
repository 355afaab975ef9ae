"""Empty: nothing this engine computes has streams, state or event time."""
