"""tarmac.functions"""
