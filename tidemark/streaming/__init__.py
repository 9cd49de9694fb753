"""Stateful streams and their batch equivalents."""
