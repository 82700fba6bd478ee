"""Helpers that shape physical plans: materialised steps, sliced groups, size-checked broadcasts."""
