"""ledgermill.plans"""
