"""Readers of listings and tables, and writers of exports."""
