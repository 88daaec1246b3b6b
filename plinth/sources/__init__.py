"""Readers, writers, inference, validation, the event generator and the journal."""
