"""linkweave.operators"""
