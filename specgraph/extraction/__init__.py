"""Source files to facts: symbols, imports, calls, contracts. A file is a row; each function maps rows to rows."""
