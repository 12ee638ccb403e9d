"""Whole jobs composed from operators: training, evaluation, sweeps, replay."""
