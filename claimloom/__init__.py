"""Part of the claimloom analytics engine."""
