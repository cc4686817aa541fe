"""Normalisation of Ukrainian text for reading aloud: passes over single texts, run on Arrow batches by holosna.operators."""
