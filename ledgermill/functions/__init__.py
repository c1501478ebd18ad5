"""ledgermill.functions"""
