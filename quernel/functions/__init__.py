"""Expressions whose results don't depend on the session's ANSI mode."""
