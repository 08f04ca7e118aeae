"""Operators for preparing language-model training data; nothing outside of this subpackage imports it."""
