"""Part of laminar."""
