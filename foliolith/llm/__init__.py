"""Operators for text corpora that feed language models. Nothing outside this subpackage imports it."""
