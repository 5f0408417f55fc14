"""DataFrame operators and the ordered event kernel."""
