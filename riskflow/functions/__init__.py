"""Row-local column expressions (all Catalyst built-ins, no Python UDFs)."""
