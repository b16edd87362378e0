"""End-to-end compositions and the registered query catalog."""
