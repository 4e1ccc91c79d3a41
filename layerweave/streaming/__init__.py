"""Micro-batch form of the incremental decomposition."""
