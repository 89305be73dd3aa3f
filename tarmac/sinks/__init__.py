"""tarmac.sinks"""
