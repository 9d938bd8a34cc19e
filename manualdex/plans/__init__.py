"""Whole queries composed from functions and operators."""
