"""ledgermill.operators"""
