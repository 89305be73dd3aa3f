"""tarmac.operators"""
