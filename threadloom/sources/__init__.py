"""Sources: driver tables, recorded provider payloads, text lists."""
