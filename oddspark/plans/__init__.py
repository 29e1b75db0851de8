"""User-level operators: cohort, background, signals, search, validation and answer scoring."""
