"""Operators for preparing training text. Each module holds one operator; ``queries`` registers them."""
