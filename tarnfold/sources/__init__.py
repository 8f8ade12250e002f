"""Readers and writers. Anything that touches a network or an optional library is handed in as a callable."""
