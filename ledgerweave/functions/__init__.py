"""Column expressions; nothing in here touches rows from Python."""
