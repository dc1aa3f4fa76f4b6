"""Readers and writers of frames, slides, concepts and graphs."""
