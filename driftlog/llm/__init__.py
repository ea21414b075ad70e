"""Operators for preparing training text. Nothing else in driftlog imports this subpackage."""
