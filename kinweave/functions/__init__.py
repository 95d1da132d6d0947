"""Column expressions. Every function takes and returns Columns; nothing runs in Python workers."""
