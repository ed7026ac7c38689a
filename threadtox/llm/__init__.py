"""Operators for preparing training text at scale; each module holds one operator and its method."""
