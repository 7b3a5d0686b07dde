"""linkweave.plans"""
