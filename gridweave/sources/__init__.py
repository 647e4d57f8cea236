"""Readers and writers of decoded drawings, rules and registry tables."""
