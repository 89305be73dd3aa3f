"""tarmac.streaming"""
