"""Operators for preparing large text collections; nothing else imports this package."""
