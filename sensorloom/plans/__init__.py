"""Registered queries: bindings of the operators to the supplied tables, with oracle SQL."""
