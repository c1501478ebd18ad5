"""ledgermill.streaming"""
