"""Reading sources, keeping intermediate results, writing reports and models."""
