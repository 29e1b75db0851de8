"""Safety-signal analytics over spontaneous reports, as Spark DataFrame operators."""
