"""Operators for building training corpora, one module each; nothing outside this subpackage imports it."""
