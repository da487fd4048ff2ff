"""The batch expressions over micro-batches."""
