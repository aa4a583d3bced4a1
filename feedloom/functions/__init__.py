"""Column functions: text, time and feedback-specific scalars."""
