"""No query on training text is plain SQL: they are tested against brute force instead."""

ORACLE: dict[str, str] = {}
