"""Column expressions: no data frame, no shuffle, all inside whole-stage code generation."""
