"""Whole workflows composed of operators: training, evaluation, experiments."""
