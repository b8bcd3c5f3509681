"""Readers, conformers, writers and stored models."""
