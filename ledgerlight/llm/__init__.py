"""Operators for preparing training data at corpus scale; nothing else in the library imports them."""
