"""Readers: one function per input shape, each ending in the shared record layout."""
