"""Logical plans that several operators build on."""
