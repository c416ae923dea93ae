"""Whole workflows: catalogue building, survey chain, training."""
