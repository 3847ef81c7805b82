"""Column functions: scalars, arrays, and text of messages and logs."""
