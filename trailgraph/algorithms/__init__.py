"""Iterative graph algorithms."""
