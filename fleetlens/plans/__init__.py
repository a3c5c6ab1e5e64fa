"""Jobs put together: the health check, and the bindings to the test tables."""
