"""Operators for language-model training data. Nothing else in papyra imports this package."""
