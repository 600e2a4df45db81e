"""Driver-side plans: trees, substitution models, partition schemes."""
