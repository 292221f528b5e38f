"""Operators for building training corpora. Nothing outside this subpackage imports it, except the guarded entry point."""
