"""Readers and writers: lesson files, sound files, release lists, course archives."""
