"""Dense layers, losses and optimisers."""
