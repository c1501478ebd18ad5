"""ledgermill.sources"""
