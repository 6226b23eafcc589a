"""Operators that prepare text for training large language models. Nothing outside this subpackage imports it."""
