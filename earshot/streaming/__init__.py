"""Stateful jobs over live chunks."""
