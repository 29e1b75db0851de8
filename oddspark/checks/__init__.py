"""Registered queries over the given star-schema tables, each with its SQL equivalent."""
