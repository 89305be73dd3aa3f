"""tarmac.sources"""
