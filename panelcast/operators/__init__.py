"""DataFrame operators; each can be used on its own."""
