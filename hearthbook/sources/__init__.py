"""Where ledger tables come from and go to."""
