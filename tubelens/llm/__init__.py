"""Operators of a training-data pipeline over the text tables. Nothing else imports this package."""
