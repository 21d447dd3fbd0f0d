"""Tables that the analyses read."""
