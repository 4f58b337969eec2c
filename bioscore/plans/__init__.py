"""Registered queries with their SQL twins, and the test fixtures they use."""
