"""DataFrame -> DataFrame operators; the tenant is always a column, never a loop."""
