"""Readers of tables, frames and feature matrices."""
