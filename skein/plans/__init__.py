"""Multi-step plans: graph components, similarity joins and the greedy split."""
