"""Nothing here: graphs are bounded, and an iteration's state is its only state."""
