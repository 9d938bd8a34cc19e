"""Column functions: tokens, codes, patterns, schedules, small scalars."""
