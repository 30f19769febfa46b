"""Column functions: text helpers, entity extraction, validation and geography."""
