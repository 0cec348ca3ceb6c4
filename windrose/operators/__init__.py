"""DataFrame operators that the dialect is lifted to."""
