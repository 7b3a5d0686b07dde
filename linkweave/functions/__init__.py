"""linkweave.functions"""
