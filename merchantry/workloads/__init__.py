"""The models and operators run over the benchmark tables."""
