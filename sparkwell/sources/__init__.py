"""Readers and writers of documents, golden sets, traces and indexes."""
