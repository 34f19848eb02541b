"""Text preparation for narration as DataFrame plans: sources, steps, chunks, checks, state, review."""
