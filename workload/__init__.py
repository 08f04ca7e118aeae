"""Queries over the driver tables, seen as a mailbox, each with its reference SQL."""
