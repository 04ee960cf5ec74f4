"""Column expressions: text in, text out.  No Python runs on the executors."""
