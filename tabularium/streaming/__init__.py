"""Tables that arrive as files in a stream."""
