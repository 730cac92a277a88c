"""Part of the ledgerlight analytics engine."""
