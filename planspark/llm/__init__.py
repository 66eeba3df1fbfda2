"""Operators for preparing training data: filters, near-duplicate joins, classifiers, language models, mixing."""
