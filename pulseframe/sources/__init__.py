"""Readers and writers of recordings, questionnaires, feature tables and results."""
