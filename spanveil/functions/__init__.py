"""Column functions: text primitives and validators."""
