"""tarmac.plans"""
