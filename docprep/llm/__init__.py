"""Operators for preparing training text, each by one stated method. Nothing else imports this package."""
