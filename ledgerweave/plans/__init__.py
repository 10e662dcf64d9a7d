"""Multi-step plans: local training, federated rounds, baseline, comparison."""
