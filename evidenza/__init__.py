"""Evidence-first retrieval analytics as DataFrame plans."""
