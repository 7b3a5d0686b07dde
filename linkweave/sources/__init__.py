"""linkweave.sources"""
