"""Job processing as streams with keyed state."""
