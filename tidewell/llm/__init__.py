"""Preparation of free text and free-entered values for training corpora. Nothing else imports this subpackage."""
