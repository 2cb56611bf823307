"""Built-in Catalyst expression helpers (no Python UDFs)."""
