"""The operators over streams of segments."""
