"""A JSON-RPC host over standard input and output."""
