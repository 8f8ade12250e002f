"""DataFrame to DataFrame operators. None of them acts at once, collects, or hides a Python function."""
