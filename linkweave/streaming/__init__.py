"""linkweave.streaming"""
